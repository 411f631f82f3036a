"""Imputation, encoding, scaling and feature functions.

Each transformer is fitted on the training rows with one aggregation job
that returns a handful of statistics, then applied as a projection (scalar
literals) or a join against a category map, which Spark broadcasts if its
measured size allows.  Semantics follow the
reference's estimators, not MLlib's defaults: population std, constant
columns map to 0, alphabetical category order, exact medians."""
from __future__ import annotations

import itertools
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import clip_negative, real
from .kinds import NUMERIC_TYPES, parse_timestamp
from .quantiles import fitted_quantiles
from .running import running_sums, sized

# Constant fills of the reference's constant imputation.
FILL_NUMBER = 0
FILL_TEXT = "missing_value"
# Low bin edge of equal-width binning is extended by this share of the range.
CUT_EDGE_EXTEND = 0.001


def _val(x: Column) -> Column:
    """Value with NaN treated as missing."""
    return F.when(~F.isnan(x), x)


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC_TYPES)


def _present(df: DataFrame, c: str) -> Column:
    x = F.col(c)
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return x.isNotNull() & ~F.isnan(x)
    return x.isNotNull()


# ---------------------------------------------------------------- imputation

def fit_imputer(train: DataFrame, columns: Sequence[str], strategy: str) -> dict:
    """Fill value per column.  ``mean``; ``median`` (exact,
    interpolated); ``most_frequent`` (smallest value on ties, numbers and
    strings); ``constant`` (0 or 'missing_value')."""
    cols = list(columns)
    if strategy == "mean":
        row = train.agg(*[F.avg(F.when(_present(train, c), F.col(c))).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    if strategy == "median":
        q = fitted_quantiles(train, cols, [0.5])
        return {c: q[c][0] for c in cols}
    if strategy in ("most_frequent", "mode"):
        out = {}
        num = [c for c in cols if _numeric(train, c)]
        txt = [c for c in cols if c not in num]
        for group, cast in ((num, "double"), (txt, "string")):
            if not group:
                continue
            long = train.select(*[F.col(c).cast(cast).alias(c) for c in group]).unpivot(
                [], group, "column", "value")
            v = F.col("value")
            keep = v.isNotNull() & (~F.isnan(v) if cast == "double" else F.lit(True))
            g = long.where(keep).groupBy("column", "value").agg(F.count("*").alias("n"))
            m = g.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
            for r in m.collect():
                out[r["column"]] = r["mode"]
        return {c: out.get(c) for c in cols}
    if strategy == "constant":
        return {c: (FILL_NUMBER if _numeric(train, c) else FILL_TEXT) for c in cols}
    raise ValueError(f"unknown imputation strategy {strategy!r}")


def apply_imputer(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    out = []
    for c in df.columns:
        if c in fills and fills[c] is not None:
            x = F.col(c)
            miss = ~_present(df, c)
            out.append(F.when(miss, F.lit(fills[c]).cast(df.schema[c].dataType)).otherwise(x).alias(c))
        else:
            out.append(F.col(c))
    return df.select(out)


# ------------------------------------------------------------------- scaling

def fit_scaler(train: DataFrame, columns: Sequence[str], kind: str) -> dict:
    """(center, scale) per column.  standard: mean / population std;
    minmax: min / range; robust: median / IQR.  A zero scale becomes 1, so a
    constant training column maps to 0."""
    cols = list(columns)
    if kind == "standard":
        row = train.agg(*[e for c in cols for e in (
            F.avg(real(c)).alias(f"m_{c}"),
            F.stddev_pop(real(c)).alias(f"s_{c}"))]).first()
        stats = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}
    elif kind == "minmax":
        row = train.agg(*[e for c in cols for e in (
            F.min(real(c)).alias(f"m_{c}"),
            F.max(real(c)).alias(f"x_{c}"))]).first()
        stats = {c: (row[f"m_{c}"], None if row[f"m_{c}"] is None else row[f"x_{c}"] - row[f"m_{c}"])
                 for c in cols}
    elif kind == "robust":
        q = fitted_quantiles(train, cols, [0.25, 0.5, 0.75])
        stats = {c: (q[c][1], None if q[c][0] is None else q[c][2] - q[c][0]) for c in cols}
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    return {c: (m, s if s not in (None, 0) else 1.0) for c, (m, s) in stats.items()}


def apply_scaler(df: DataFrame, stats: Mapping[str, tuple]) -> DataFrame:
    return df.select(*[((F.col(c).cast("double") - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c)
                       if c in stats else F.col(c) for c in df.columns])


def minmax_normalise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x − min)/(max − min) over the frame itself; zero range → 1."""
    return apply_scaler(df, fit_scaler(df, columns, "minmax"))


# ------------------------------------------------------------------ encoding

def category_levels(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category, index) — alphabetical index per column."""
    long = train.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "category")
    d, n = sized(long.where(F.col("category").isNotNull()).distinct().withColumn("_one", F.lit(1)))
    return running_sums(d, ["column"], "category", ["_one"], n_rows=n).select(
        "column", "category", (F.col("cum__one") - 1).cast("bigint").alias("index"))


def fit_onehot(train: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """sorted categories per column (they become output columns, so
    their number is bounded by the output schema anyway)."""
    levels = category_levels(train, columns).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in sorted(levels, key=lambda r: (r["column"], r["index"])):
        out[r["column"]].append(r["category"])
    return out


def apply_onehot(df: DataFrame, cats: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """One 0/1 column ``<col>_<category>`` per level; unseen and null → all 0."""
    out = [F.col(c) for c in df.columns if c not in cats or c in keep]
    for c, levels in cats.items():
        x = F.col(c).cast("string")
        out += [F.when(x == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}") for v in levels]
    return df.select(out)


def apply_ordinal(df: DataFrame, levels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """alphabetical index; unseen or null → -1.  Each column joins its
    own slice of the (column, category, index) map."""
    out = df
    for c in columns:
        m = levels.where(F.col("column") == c).select(
            F.col("category").alias(f"_cat_{c}"), F.col("index").alias(f"_ix_{c}"))
        out = out.join(m, F.col(c).cast("string") == F.col(f"_cat_{c}"), "left")
        out = out.withColumn(c, F.coalesce(F.col(f"_ix_{c}"), F.lit(-1)).cast("double")) \
                 .drop(f"_cat_{c}", f"_ix_{c}")
    return out


def fit_target_encoder(train: DataFrame, columns: Sequence[str], target: str,
                       classes: Sequence | None = None) -> tuple[DataFrame, dict]:
    """F8: empirical-Bayes target encoding.  Per category: n, mean and
    population variance of y; λ = n·σ²_y / (n·σ²_y + σ²_cat);
    enc = λ·mean_cat + (1 − λ)·mean_y.  ``classes`` given → one-vs-rest
    encodings, one output per class.  Returns (map, global means)."""
    targets = {"": F.col(target).cast("double")} if classes is None else {
        str(k): (F.col(target) == F.lit(k)).cast("double") for k in classes}
    maps = []
    globals_ = {}
    for suffix, y in targets.items():
        gy = train.agg(F.avg(y).alias("m"), F.var_pop(y).alias("v")).first()
        globals_[suffix] = (gy["m"], gy["v"])
        long = train.select(y.alias("_y"), *[F.col(c).cast("string").alias(c) for c in columns]) \
            .unpivot(["_y"], list(columns), "column", "category")
        g = long.groupBy("column", "category").agg(
            F.count("*").alias("n"), F.avg("_y").alias("mc"), F.var_pop("_y").alias("vc"))
        lam = F.try_divide(F.col("n") * F.lit(gy["v"]), F.col("n") * F.lit(gy["v"]) + F.col("vc"))
        enc = F.coalesce(lam * F.col("mc") + (1 - lam) * F.lit(gy["m"]), F.lit(gy["m"]))
        maps.append(g.select("column", "category", F.lit(suffix).alias("cls"), enc.alias("enc")))
    m = maps[0]
    for x in maps[1:]:
        m = m.unionByName(x)
    return m, globals_


def apply_target_encoder(df: DataFrame, m: DataFrame, globals_: dict, columns: Sequence[str]) -> DataFrame:
    """Unseen or null category → global target mean."""
    out = df
    for c in columns:
        for suffix, (gm, _) in globals_.items():
            name = c if suffix == "" else f"{c}_{suffix}"
            mm = m.where((F.col("column") == c) & (F.col("cls") == suffix)).select(
                F.col("category").alias("_cat"), F.col("enc").alias("_enc"))
            out = out.join(mm, F.col(c).cast("string") == F.col("_cat"), "left")
            out = out.withColumn(f"_te_{name}", F.coalesce(F.col("_enc"), F.lit(gm))).drop("_cat", "_enc")
        out = out.drop(c)
        for suffix in globals_:
            name = c if suffix == "" else f"{c}_{suffix}"
            out = out.withColumnRenamed(f"_te_{name}", name)
    return out


# ------------------------------------------------------------ feature funcs

def datetime_parts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """<col>_year/_month/_day/_dayofweek (Monday = 0); originals
    dropped; text is parsed with the accepted layouts, failures → null."""
    out = [F.col(c) for c in df.columns if c not in columns]
    for c in columns:
        if c not in df.columns:
            continue
        dt = df.schema[c].dataType
        ts = F.col(c) if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)) \
            else parse_timestamp(F.col(c).cast("string"))
        out += [F.year(ts).alias(f"{c}_year"), F.month(ts).alias(f"{c}_month"),
                F.dayofmonth(ts).alias(f"{c}_day"), F.weekday(ts).alias(f"{c}_dayofweek")]
    return df.select(out)


def log1p_clipped(c) -> Column:
    """log1p after clipping negatives to 0 (null stays null)."""
    return F.log1p(clip_negative(c))


def sqrt_clipped(c) -> Column:
    """F14."""
    return F.sqrt(clip_negative(c))


def polynomial_terms(n: int, degree: int, interaction_only: bool = False) -> list[tuple[int, ...]]:
    """Index tuples in the reference's order: by degree, then
    lexicographic combinations (with replacement unless interaction only)."""
    terms: list[tuple[int, ...]] = []
    for d in range(1, degree + 1):
        comb = itertools.combinations if interaction_only else itertools.combinations_with_replacement
        terms += list(comb(range(n), d))
    return terms


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2,
                        interaction_only: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``poly_i`` columns, no bias term."""
    terms = polynomial_terms(len(columns), degree, interaction_only)
    exprs = []
    for k, t in enumerate(terms):
        e = F.lit(1.0)
        for i in t:
            e = e * F.col(columns[i]).cast("double")
        exprs.append(e.alias(f"poly_{k}"))
    return df.select(*[F.col(c) for c in keep], *exprs)


def fit_cut_edges(train: DataFrame, column: str, bins: int) -> list[float]:
    """equal-width edges over the training range; the low edge moves
    down by 0.1 % of the range (a constant column widens by 0.1 %)."""
    r = train.agg(F.min(F.col(column).cast("double")).alias("lo"),
                  F.max(F.col(column).cast("double")).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return []
    if lo == hi:
        lo = lo - CUT_EDGE_EXTEND * abs(lo) if lo != 0 else lo - CUT_EDGE_EXTEND
        hi = hi + CUT_EDGE_EXTEND * abs(hi) if hi != 0 else hi + CUT_EDGE_EXTEND
        step = (hi - lo) / bins
        edges = [i * step + lo for i in range(bins)] + [hi]
        return edges
    step = (hi - lo) / bins
    edges = [i * step + lo for i in range(bins)] + [hi]
    edges[0] = edges[0] - (hi - lo) * CUT_EDGE_EXTEND
    return edges


def cut_bin(c, edges: Sequence[float]) -> Column:
    """Right-closed bin index with the lowest edge included; values outside
    the edges (and nulls) → 0."""
    x = F.col(c) if isinstance(c, str) else c
    if not edges:
        return F.lit(0.0)
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    idx = F.lit(0)
    for e in edges[1:-1]:
        idx = idx + F.when(x > F.lit(e), 1).otherwise(0)
    return F.when(inside, idx).otherwise(0).cast("double")


def fit_quantile_edges(train: DataFrame, column: str, bins: int) -> list[float]:
    """exact quantile edges at i/bins."""
    q = fitted_quantiles(train, [column], [i / bins for i in range(bins + 1)])[column]
    return q


def quantile_bin(c, edges: Sequence[float]) -> Column:
    """Bin = number of interior quantile edges <= x, clamped to [0, bins-1]."""
    x = F.col(c) if isinstance(c, str) else c
    idx = F.lit(0)
    for e in edges[1:-1]:
        idx = idx + F.when(x >= F.lit(e), 1).otherwise(0)
    return F.when(x.isNull(), F.lit(None)).otherwise(idx).cast("double")


# ------------------------------------------------------------ recipes (P12+)

@dataclass
class ColumnRecipe:
    kind: str
    imputation: str = "median"
    transform: str = "standard"  # scaling for numbers, encoding for categories, 'drop'


def smart_defaults(kinds: Mapping[str, str], target: str | None) -> dict[str, ColumnRecipe]:
    """Numerical → median + standard; categorical → most frequent +
    one-hot; datetime/text → drop; the target is excluded."""
    out = {}
    for c, k in kinds.items():
        if c == target:
            continue
        if k == "numerical":
            out[c] = ColumnRecipe(k, "median", "standard")
        elif k == "categorical":
            out[c] = ColumnRecipe(k, "most_frequent", "onehot")
        else:
            out[c] = ColumnRecipe(k, "none", "drop")
    return out


#: What a recipe may ask for, by kind; ``drop`` leaves the column out.
TRANSFORMS = {
    "numerical": ("standard", "minmax", "robust", "none", "drop"),
    "categorical": ("onehot", "ordinal", "label", "target", "none", "drop"),
    "datetime": ("extract", "none", "drop"),
    "text": ("none", "drop"),
}
DATE_PARTS = ("year", "month", "day", "dayofweek")


@dataclass
class Preprocessor:
    """Fitted recipe.  Each kind of statistic is fitted for all its
    columns at once; ``transform`` is a projection plus one join per ordinal or
    target-encoded column."""
    recipes: dict[str, ColumnRecipe]
    target: str | None = None
    fills: dict = field(default_factory=dict)
    scalers: dict = field(default_factory=dict)
    onehot: dict = field(default_factory=dict)
    ordinal_cols: list = field(default_factory=list)
    ordinal_map: DataFrame | None = None
    drop_rows: list = field(default_factory=list)
    target_cols: list = field(default_factory=list)
    target_map: DataFrame | None = None
    target_means: dict = field(default_factory=dict)
    date_cols: list = field(default_factory=list)

    def __post_init__(self):
        for c, r in self.recipes.items():
            if r.transform not in TRANSFORMS.get(r.kind, ("none", "drop")):
                raise ValueError(f"{c}: a {r.kind} column has no transform {r.transform!r}")

    def _columns(self, *transforms: str) -> list[str]:
        return [c for c in self.feature_columns if self.recipes[c].transform in transforms]

    def fit(self, train: DataFrame) -> "Preprocessor":
        self.drop_rows = [c for c, r in self.recipes.items() if r.imputation == "drop" and r.transform != "drop"]
        base = train.na.drop(subset=self.drop_rows) if self.drop_rows else train
        for how in sorted({self.recipes[c].imputation for c in self.feature_columns} - {"none", None}):
            self.fills |= fit_imputer(base, [c for c in self.feature_columns if self.recipes[c].imputation == how], how)
        filled = apply_imputer(base, self.fills)
        for scale in ("standard", "minmax", "robust"):
            if cols := self._columns(scale):
                self.scalers |= fit_scaler(filled, cols, scale)
        if cols := self._columns("onehot"):
            self.onehot = fit_onehot(filled, cols)
        self.ordinal_cols = self._columns("ordinal", "label")
        if self.ordinal_cols:
            self.ordinal_map = category_levels(filled, self.ordinal_cols)
        self.target_cols, self.date_cols = self._columns("target"), self._columns("extract")
        if self.target_cols:
            self.target_map, self.target_means = self._fit_target(filled)
        return self

    def _fit_target(self, filled: DataFrame) -> tuple[DataFrame, dict]:
        """Means of a number; of the second of two classes; or of each of several classes."""
        if self.target is None:
            raise ValueError("target encoding needs a target")
        if isinstance(filled.schema[self.target].dataType, NUMERIC_TYPES):
            return fit_target_encoder(filled, self.target_cols, self.target)
        classes = [r[0] for r in category_levels(filled, [self.target]).orderBy("index").select("category").collect()]
        if len(classes) > 2:
            return fit_target_encoder(filled, self.target_cols, self.target, classes)
        second = (F.col(self.target).cast("string") == F.lit(classes[-1])).cast("double")
        return fit_target_encoder(filled.withColumn(self.target, second), self.target_cols, self.target)

    @property
    def feature_columns(self) -> list[str]:
        return [c for c, r in self.recipes.items() if r.transform != "drop" and r.imputation != "drop"]

    def output_names(self) -> list[str]:
        names = []
        for c in self.feature_columns:
            if c in self.onehot:
                names += [f"{c}_{v}" for v in self.onehot[c]]
            elif c in self.date_cols:
                names += [f"{c}_{part}" for part in DATE_PARTS]
            elif c in self.target_cols:
                names += [c if k == "" else f"{c}_{k}" for k in self.target_means]
            else:
                names.append(c)
        return names

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        x = df.na.drop(subset=self.drop_rows) if self.drop_rows else df
        x = x.select(*keep, *[c for c in self.feature_columns if c not in keep])
        x = apply_imputer(x, self.fills)
        x = apply_scaler(x, self.scalers)
        if self.ordinal_cols:
            x = apply_ordinal(x, self.ordinal_map, self.ordinal_cols)
        if self.target_cols:
            x = apply_target_encoder(x, self.target_map, self.target_means, self.target_cols)
        if self.date_cols:
            x = datetime_parts(x, self.date_cols)
        x = apply_onehot(x, self.onehot, keep)
        return x.select(*keep, *self.output_names())

    def to_json(self) -> str:
        """Serving schema (recipes and fitted statistics)."""
        return json.dumps({
            "target": self.target,
            "recipes": {c: vars(r) for c, r in self.recipes.items()},
            "fills": self.fills, "scalers": self.scalers, "onehot": self.onehot,
            "ordinal_cols": self.ordinal_cols, "drop_rows": self.drop_rows,
            "target_cols": self.target_cols, "target_means": self.target_means, "date_cols": self.date_cols,
            "output_names": self.output_names(),
        }, default=str)


def save_preprocessor(pre: "Preprocessor", spark, path: str) -> None:
    """Fitted statistics and recipes as one JSON record (written by
    Spark, so any shared filesystem works); the category maps as Parquet."""
    spark.createDataFrame([(pre.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/schema")
    for name in ("ordinal_map", "target_map"):
        if getattr(pre, name) is not None:
            getattr(pre, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_preprocessor(spark, path: str) -> "Preprocessor":
    meta = json.loads(spark.read.text(path + "/schema").first()["value"])
    rec = {c: ColumnRecipe(**r) for c, r in meta["recipes"].items()}
    pre = Preprocessor(rec, target=meta["target"], fills=meta["fills"],
                       scalers={c: tuple(v) for c, v in meta["scalers"].items()},
                       onehot=meta["onehot"], ordinal_cols=meta["ordinal_cols"], drop_rows=meta["drop_rows"],
                       target_cols=meta["target_cols"], date_cols=meta["date_cols"],
                       target_means={k: tuple(v) for k, v in meta["target_means"].items()})
    if pre.ordinal_cols:
        pre.ordinal_map = spark.read.parquet(path + "/ordinal_map")
    if pre.target_cols:
        pre.target_map = spark.read.parquet(path + "/target_map")
    return pre


def drop_target(df: DataFrame, target: str | None) -> DataFrame:
    """P10: a scoring frame never carries the target column."""
    return df.drop(target) if target and target in df.columns else df
