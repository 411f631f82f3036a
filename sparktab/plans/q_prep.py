"""Split, cleaning, imputation, scaling, encoding and feature-function
queries.  Transformers are fitted on the hash split's train rows and applied
to every row, exactly like fit-on-train / transform-all."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import round_all
from ..operators import clean as C
from ..operators import prep as PR
from ..operators import split as S
from ..sources.tables import table
from .q_profile import orders_nulls
from .registry import query
from .sqlgen import ORDERS_N, hash_order


def split_sql(src: str, key: str, group: str | None = None, test=0.2, val=0.1) -> str:
    part = f"PARTITION BY {group}" if group else ""
    rel = S.relative_val(test, val)
    t = f"CAST({round(test, 9)} AS DECIMAL(20,9))"
    r = f"CAST({rel} AS DECIMAL(20,9))"
    return f"""SELECT * EXCLUDE (rk, n, nt, nv), CASE WHEN rk < nt THEN 'test' WHEN rk < nt + nv THEN 'val'
  ELSE 'train' END AS split FROM (SELECT *, ceil({t} * n) AS nt, ceil({r} * (n - ceil({t} * n))) AS nv FROM
  (SELECT *, row_number() OVER ({part} ORDER BY {hash_order(key)}, {key}) - 1 AS rk,
     count(*) OVER ({part}) AS n FROM {src}))"""


def strata_sql(src: str, key: str, group: str, test=0.2, val=0.1) -> str:
    """Largest remainder over strata, from the rule: floors first, the rest to the
    largest remainders, one training row per stratum."""
    rel = S.relative_val(test, val)

    def allot(rows, size, total, out):
        return f"""(SELECT * EXCLUDE (base, rem, nth, given), base + CASE WHEN base < {size} - 1 AND nth <= {total} - given
    THEN 1 ELSE 0 END AS {out} FROM (SELECT *, sum(base) OVER () AS given,
      row_number() OVER (PARTITION BY base < {size} - 1 ORDER BY rem DESC, {group}) AS nth FROM
      (SELECT *, greatest(0, least({total} * {size} // al, {size} - 1)) AS base, {total} * {size} % al AS rem FROM
        (SELECT *, greatest(1, sum({size}) OVER ()) AS al FROM {rows}))))"""

    strata = f"""(SELECT *, CAST(ceil(CAST({test} AS DECIMAL(20,9)) * sum(n) OVER ()) AS HUGEINT) AS tt FROM
      (SELECT {group}, CAST(count(*) AS HUGEINT) AS n FROM {src} GROUP BY {group}))"""
    first = f"""(SELECT {group}, n, nt, n - nt AS m, CAST(ceil(CAST({rel} AS DECIMAL(20,9)) * sum(n - nt) OVER ()) AS HUGEINT) AS vt
      FROM {allot(strata, 'n', 'tt', 'nt')})"""
    return f"""SELECT x.* EXCLUDE (rk), CASE WHEN rk <= nt THEN 'test' WHEN rk <= nt + nv THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {hash_order(key)}, {key}) AS rk FROM {src}) x
  JOIN {allot(first, 'm', 'vt', 'nv')} s USING ({group})"""


def orders_split(spark, sf):
    return S.assign_split(orders_nulls(spark, sf), "o_orderkey")


def train_of(df):
    return df.where(F.col("split") == "train")


SPLIT_CTE = f"WITH {ORDERS_N}, sp AS ({split_sql('orders_n', 'o_orderkey')}), train AS (SELECT * FROM sp WHERE split = 'train')"


# ------------------------------------------------------------------ splits

@query("split_random", f"SELECT o_orderkey, split FROM ({split_sql('orders', 'o_orderkey')})")
def split_random(spark, sf):
    return S.assign_split(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "split")


@query("split_stratified_many", f"SELECT o_orderkey, o_custkey, split FROM ({strata_sql('orders', 'o_orderkey', 'o_custkey')})")
def split_stratified_many(spark, sf):
    """One stratum per customer: thousands of small strata."""
    return S.assign_split(table(spark, sf, "orders"), "o_orderkey", "o_custkey", stratify=True).select(
        "o_orderkey", "o_custkey", "split")


@query("split_stratified", f"SELECT o_orderkey, o_orderstatus, split FROM ({strata_sql('orders', 'o_orderkey', 'o_orderstatus')})")
def split_stratified(spark, sf):
    o = table(spark, sf, "orders")
    return S.assign_split(o, "o_orderkey", "o_orderstatus", stratify=True).select(
        "o_orderkey", "o_orderstatus", "split")


@query("split_sizes", f"SELECT split, CAST(count(*) AS BIGINT) AS \"rows\" FROM ({split_sql('orders', 'o_orderkey')}) GROUP BY split")
def split_sizes(spark, sf):
    return S.split_sizes(S.assign_split(table(spark, sf, "orders"), "o_orderkey"))


@query("kfold_stratified", f"""SELECT o_orderkey, o_orderpriority, CAST(rk % 5 AS INT) AS fold FROM
  (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hash_order('o_orderkey')}, o_orderkey) - 1 AS rk FROM orders)""")
def kfold_stratified(spark, sf):
    o = table(spark, sf, "orders")
    return S.assign_folds(o, "o_orderkey", 5, "o_orderpriority").select("o_orderkey", "o_orderpriority", "fold")


@query("learning_curve_sizes", f"""WITH r AS (SELECT row_number() OVER (ORDER BY {hash_order('c_custkey')}, c_custkey) - 1 AS rk,
  count(*) OVER () AS n FROM customer), s AS (SELECT i AS size_idx, 0.1 + i * (1.0 - 0.1) / 7 AS fraction FROM range(0, 8) t(i))
SELECT CAST(size_idx AS INT) AS size_idx, CAST(count(*) AS BIGINT) AS "rows" FROM r, s WHERE rk < ceil(fraction * n) GROUP BY size_idx""")
def learning_curve_sizes(spark, sf):
    sub = S.learning_curve_subsets(table(spark, sf, "customer"), "c_custkey")
    return sub.groupBy("size_idx").agg(F.count("*").cast("bigint").alias("rows"))


# ------------------------------------------------------------- imputation

@query("impute_mean", f"""{SPLIT_CTE}, m AS (SELECT avg(price_n) AS m FROM train WHERE NOT isnan(price_n))
SELECT o_orderkey, round(coalesce(price_n, m), 6) AS price_n FROM sp, m""")
def impute_mean(spark, sf):
    df = orders_split(spark, sf)
    fills = PR.fit_imputer(train_of(df), ["price_n"], "mean")
    return round_all(PR.apply_imputer(df.select("o_orderkey", "price_n"), fills), 6)


@query("impute_median", f"""{SPLIT_CTE}, m AS (SELECT quantile_cont(price_n, 0.5) AS m FROM train WHERE NOT isnan(price_n))
SELECT o_orderkey, round(coalesce(price_n, m), 6) AS price_n FROM sp, m""")
def impute_median(spark, sf):
    df = orders_split(spark, sf)
    fills = PR.fit_imputer(train_of(df), ["price_n"], "median")
    return round_all(PR.apply_imputer(df.select("o_orderkey", "price_n"), fills), 6)


@query("impute_mode", f"""{SPLIT_CTE},
mp AS (SELECT priority_n AS m FROM train WHERE priority_n IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
mc AS (SELECT o_custkey AS m FROM train WHERE o_orderkey % 5 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(priority_n, mp.m) AS priority_n,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(mc.m AS BIGINT) ELSE o_custkey END AS cust_n FROM sp, mp, mc""")
def impute_mode(spark, sf):
    df = orders_split(spark, sf).withColumn(
        "cust_n", F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_custkey")))
    fills = PR.fit_imputer(train_of(df), ["priority_n", "cust_n"], "most_frequent")
    return PR.apply_imputer(df.select("o_orderkey", "priority_n", "cust_n"), fills)


@query("impute_constant", f"""{SPLIT_CTE} SELECT o_orderkey, coalesce(price_n, 0.0) AS price_n,
  coalesce(priority_n, 'missing_value') AS priority_n FROM sp""")
def impute_constant(spark, sf):
    df = orders_split(spark, sf)
    fills = PR.fit_imputer(train_of(df), ["price_n", "priority_n"], "constant")
    return PR.apply_imputer(df.select("o_orderkey", "price_n", "priority_n"), fills)


# ----------------------------------------------------------------- scaling
SCALE_COLS = ["o_totalprice", "o_custkey", "const_one"]


def _scale_sql(kind: str) -> str:
    fits, outs = [], []
    for c in SCALE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        if kind == "standard":
            fits.append(f"avg({x}) AS c_{c}, stddev_pop({x}) AS s_{c}")
        elif kind == "minmax":
            fits.append(f"min({x}) AS c_{c}, max({x}) - min({x}) AS s_{c}")
        else:
            fits.append(f"quantile_cont({x}, 0.5) AS c_{c}, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS s_{c}")
        outs.append(f"round(({x} - c_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END), 6) AS {c}")
    return f"{SPLIT_CTE}, f AS (SELECT {', '.join(fits)} FROM train) SELECT o_orderkey, {', '.join(outs)} FROM sp, f"


def _scale(kind):
    def run(spark, sf):
        df = orders_split(spark, sf)
        st = PR.fit_scaler(train_of(df), SCALE_COLS, kind)
        return round_all(PR.apply_scaler(df.select("o_orderkey", *SCALE_COLS), st), 6)
    return run


for _k in ("standard", "minmax", "robust"):
    query(f"scale_{_k}", _scale_sql(_k))(_scale(_k))

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("minmax_normalise", """WITH f AS (SELECT min(CAST(p_size AS DOUBLE)) AS a1, max(CAST(p_size AS DOUBLE)) - min(CAST(p_size AS DOUBLE)) AS r1,
  min(p_retailprice) AS a2, max(p_retailprice) - min(p_retailprice) AS r2 FROM part)
SELECT p_partkey, round((p_size - a1) / CASE WHEN r1 = 0 THEN 1 ELSE r1 END, 6) AS p_size,
  round((p_retailprice - a2) / CASE WHEN r2 = 0 THEN 1 ELSE r2 END, 6) AS p_retailprice FROM part, f""")
def minmax_normalise(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return round_all(PR.minmax_normalise(p, ["p_size", "p_retailprice"]), 6)


# ---------------------------------------------------------------- encoding

def _onehot_sql():
    cols = ", ".join(
        f"""CASE WHEN priority_n = '{v}' THEN 1.0 ELSE 0.0 END AS "priority_n_{v}" """ for v in PRIORITIES)
    return f"{SPLIT_CTE} SELECT o_orderkey, {cols} FROM sp"


@query("onehot_encode", _onehot_sql())
def onehot_encode(spark, sf):
    df = orders_split(spark, sf)
    cats = PR.fit_onehot(train_of(df), ["priority_n"])
    return PR.apply_onehot(df.select("o_orderkey", "priority_n"), cats)


@query("ordinal_encode", f"""{SPLIT_CTE}, lv AS (SELECT o_orderpriority AS c, row_number() OVER (ORDER BY o_orderpriority) - 1 AS ix
  FROM (SELECT DISTINCT o_orderpriority FROM train WHERE o_orderpriority <> '5-LOW'))
SELECT o_orderkey, CAST(coalesce(ix, -1) AS DOUBLE) AS o_orderpriority FROM sp LEFT JOIN lv ON sp.o_orderpriority = lv.c""")
def ordinal_encode(spark, sf):
    df = orders_split(spark, sf)
    fit_rows = train_of(df).where(F.col("o_orderpriority") != "5-LOW")
    levels = PR.category_levels(fit_rows, ["o_orderpriority"])
    return PR.apply_ordinal(df.select("o_orderkey", "o_orderpriority"), levels, ["o_orderpriority"])


def _te_sql(ys: dict[str, str]) -> str:
    ctes, outs, joins = [], [], []
    for name, y in ys.items():
        ctes.append(f"""gy_{name} AS (SELECT avg({y}) AS m, var_pop({y}) AS v FROM train),
g_{name} AS (SELECT o_orderpriority AS c, count(*) AS n, avg({y}) AS mc, var_pop({y}) AS vc FROM train GROUP BY 1),
e_{name} AS (SELECT c, coalesce((n * v / nullif(n * v + vc, 0)) * mc + (1 - n * v / nullif(n * v + vc, 0)) * m, m) AS enc
  FROM g_{name}, gy_{name})""")
        col = "o_orderpriority" if name == "y" else f'"o_orderpriority_{name}"'
        outs.append(f"round(coalesce(e_{name}.enc, gy_{name}.m), 6) AS {col}")
        joins.append(f"LEFT JOIN e_{name} ON sp.o_orderpriority = e_{name}.c CROSS JOIN gy_{name}")
    return f"{SPLIT_CTE}, {', '.join(ctes)} SELECT o_orderkey, {', '.join(outs)} FROM sp {' '.join(joins)}"


@query("target_encode", _te_sql({"y": "o_totalprice"}))
def target_encode(spark, sf):
    df = orders_split(spark, sf)
    m, g = PR.fit_target_encoder(train_of(df), ["o_orderpriority"], "o_totalprice")
    return round_all(PR.apply_target_encoder(df.select("o_orderkey", "o_orderpriority"), m, g,
                                             ["o_orderpriority"]), 6)


@query("target_encode_multiclass", _te_sql({k: f"CAST(o_orderstatus = '{k}' AS DOUBLE)" for k in ["F", "O", "P"]}))
def target_encode_multiclass(spark, sf):
    df = orders_split(spark, sf)
    m, g = PR.fit_target_encoder(train_of(df), ["o_orderpriority"], "o_orderstatus", classes=["F", "O", "P"])
    out = PR.apply_target_encoder(df.select("o_orderkey", "o_orderpriority", "o_orderstatus"), m, g,
                                  ["o_orderpriority"])
    return round_all(out.drop("o_orderstatus"), 6)


# ------------------------------------------------------- feature functions

@query("datetime_parts", """SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
  day(o_orderdate) AS o_orderdate_day, isodow(o_orderdate) - 1 AS o_orderdate_dayofweek,
  year(d) AS date_text_year, month(d) AS date_text_month, day(d) AS date_text_day, isodow(d) - 1 AS date_text_dayofweek
FROM (SELECT *, try_strptime(CASE WHEN o_orderkey % 17 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END, '%Y-%m-%d') AS d FROM orders)""")
def datetime_parts(spark, sf):
    o = table(spark, sf, "orders")
    o = o.select("o_orderkey", "o_orderdate",
                 F.when(F.col("o_orderkey") % 17 == 0, F.lit("not a date"))
                 .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_text"))
    out = PR.datetime_parts(o, ["o_orderdate", "date_text"])
    return out.select([F.col(c).cast("bigint").alias(c) if c != "o_orderkey" else F.col(c) for c in out.columns])


@query("log_sqrt_transform", """SELECT c_custkey, round(ln(1 + CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END), 6) AS log1p_acctbal,
  round(sqrt(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END), 6) AS sqrt_acctbal FROM customer""")
def log_sqrt_transform(spark, sf):
    c = table(spark, sf, "customer")
    return round_all(c.select("c_custkey", PR.log1p_clipped("c_acctbal").alias("log1p_acctbal"),
                              PR.sqrt_clipped("c_acctbal").alias("sqrt_acctbal")), 6)


def _poly_sql(degree, inter):
    cols = ["CAST(p_size AS DOUBLE)", "p_retailprice"]
    terms = PR.polynomial_terms(2, degree, inter)
    exprs = []
    for k, t in enumerate(terms):
        e = "1.0"
        for i in t:
            e = f"({e} * {cols[i]})"
        exprs.append(f"round({e}, 6) AS poly_{k}")
    return f"SELECT p_partkey, {', '.join(exprs)} FROM part"


def _poly(degree, inter):
    def run(spark, sf):
        p = table(spark, sf, "part")
        return round_all(PR.polynomial_features(p, ["p_size", "p_retailprice"], degree, inter, keep=["p_partkey"]), 6)
    return run


query("poly_degree2", _poly_sql(2, False))(_poly(2, False))
query("poly_degree3", _poly_sql(3, False))(_poly(3, False))
query("poly_interactions", _poly_sql(2, True))(_poly(2, True))

CUST_SPLIT = f"WITH sp AS ({split_sql('customer', 'c_custkey')}), train AS (SELECT * FROM sp WHERE split = 'train')"


def _cut_sql(bins=5):
    inner = " + ".join(f"(CASE WHEN c_acctbal > {i} * ((hi - lo) / {float(bins)}) + lo THEN 1 ELSE 0 END)"
                       for i in range(1, bins))
    return f"""{CUST_SPLIT}, f AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM train)
SELECT c_custkey, CAST(CASE WHEN c_acctbal >= lo - (hi - lo) * 0.001 AND c_acctbal <= hi THEN {inner} ELSE 0 END AS DOUBLE) AS acctbal_bin
FROM sp, f"""


@query("equal_width_bins", _cut_sql())
def equal_width_bins(spark, sf):
    c = S.assign_split(table(spark, sf, "customer"), "c_custkey")
    edges = PR.fit_cut_edges(train_of(c), "c_acctbal", 5)
    return c.select("c_custkey", PR.cut_bin("c_acctbal", edges).alias("acctbal_bin"))


@query("quantile_bins", f"""{CUST_SPLIT}, f AS (SELECT quantile_cont(c_acctbal, 0.25) AS e1, quantile_cont(c_acctbal, 0.5) AS e2,
  quantile_cont(c_acctbal, 0.75) AS e3 FROM train)
SELECT c_custkey, CAST((CASE WHEN c_acctbal >= e1 THEN 1 ELSE 0 END) + (CASE WHEN c_acctbal >= e2 THEN 1 ELSE 0 END)
  + (CASE WHEN c_acctbal >= e3 THEN 1 ELSE 0 END) AS DOUBLE) AS acctbal_qbin FROM sp, f""")
def quantile_bins(spark, sf):
    c = S.assign_split(table(spark, sf, "customer"), "c_custkey")
    edges = PR.fit_quantile_edges(train_of(c), "c_acctbal", 4)
    return c.select("c_custkey", PR.quantile_bin("c_acctbal", edges).alias("acctbal_qbin"))


# ---------------------------------------------------------------- cleaning

@query("drop_missing_rows", f"""WITH {ORDERS_N} SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders_n WHERE price_n IS NOT NULL AND NOT isnan(price_n) AND priority_n IS NOT NULL""")
def drop_missing_rows(spark, sf):
    d = C.drop_missing_rows(orders_nulls(spark, sf), ["price_n", "priority_n"])
    return d.agg(F.count("*").cast("bigint").alias("rows"), F.sum("o_orderkey").cast("bigint").alias("key_sum"))


@query("drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def drop_duplicates(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return C.drop_duplicate_rows(li)


LV_COLS = ["l_quantity", "l_discount", "l_tax"]


@query("low_variance", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(var_pop(coalesce({c}, m)), 6) AS variance, round(var_samp({c}), 6) AS sample_variance,
  coalesce(var_pop(coalesce({c}, m)) <= 0.01, true) AS dropped, coalesce(var_samp({c}) < 0.01, false) AS preview_dropped
  FROM lineitem, (SELECT quantile_cont({c}, 0.5) AS m FROM lineitem)""" for c in LV_COLS))
def low_variance(spark, sf):
    return round_all(C.low_variance_report(table(spark, sf, "lineitem"), LV_COLS), 6)


HC_COLS = ["o_totalprice", "price_n", "o_custkey", "const_one"]


def _hc_sql():
    parts = [f"SELECT '{HC_COLS[0]}' AS \"column\", CAST(NULL AS DOUBLE) AS max_abs_corr, false AS dropped"]
    for j in range(1, len(HC_COLS)):
        rs = []
        for i in range(j):
            a, b = HC_COLS[i], HC_COLS[j]
            m = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            xa, xb = f"CASE WHEN {m} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {m} THEN CAST({b} AS DOUBLE) END"
            rs.append(f"SELECT abs(covar_pop({xa}, {xb}) / nullif(stddev_pop({xa}) * stddev_pop({xb}), 0)) AS r FROM orders_n")
        parts.append(f"""SELECT '{HC_COLS[j]}' AS "column", round(max(r), 6) AS max_abs_corr,
  coalesce(max(coalesce(r > 0.95, false)), false) AS dropped FROM ({' UNION ALL '.join(rs)})""")
    return f"WITH {ORDERS_N} " + " UNION ALL ".join(parts)


@query("high_correlation", _hc_sql())
def high_correlation(spark, sf):
    return round_all(C.high_correlation_report(orders_nulls(spark, sf), HC_COLS), 6)


RANGES = {"l_quantity": (5.0, 45.0), "l_discount": (0.01, 0.09)}


@query("range_violations", """SELECT 'l_quantity' AS "column", CAST(count(*) FILTER (WHERE l_quantity < 5.0 OR l_quantity > 45.0) AS BIGINT) AS out_of_range FROM lineitem
UNION ALL SELECT 'l_discount', CAST(count(*) FILTER (WHERE l_discount < 0.01 OR l_discount > 0.09) AS BIGINT) FROM lineitem""")
def range_violations(spark, sf):
    return C.out_of_range_count(table(spark, sf, "lineitem"), RANGES)


@query("range_clip", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5.0 THEN 5.0 WHEN l_quantity > 45.0 THEN 45.0 ELSE l_quantity END AS l_quantity,
  CASE WHEN l_discount < 0.01 THEN 0.01 WHEN l_discount > 0.09 THEN 0.09 ELSE l_discount END AS l_discount FROM lineitem""")
def range_clip(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return C.clip_ranges(li, RANGES)


REGEX = {"priority_n": "[1-3]-", "o_orderstatus": "[FO]"}


@query("regex_report", f"""WITH {ORDERS_N} SELECT 'priority_n' AS "column",
  CAST(count(*) FILTER (WHERE NOT regexp_matches(coalesce(priority_n, 'nan'), '^(?:[1-3]-)')) AS BIGINT) AS non_matching FROM orders_n
UNION ALL SELECT 'o_orderstatus', CAST(count(*) FILTER (WHERE NOT regexp_matches(coalesce(o_orderstatus, 'nan'), '^(?:[FO])')) AS BIGINT) FROM orders_n""")
def regex_report(spark, sf):
    return C.regex_report(orders_nulls(spark, sf), REGEX)


@query("regex_validate", f"""WITH {ORDERS_N} SELECT o_orderkey,
  CASE WHEN regexp_matches(coalesce(priority_n, 'nan'), '^(?:[1-3]-)') THEN priority_n END AS priority_n,
  CASE WHEN regexp_matches(coalesce(o_orderstatus, 'nan'), '^(?:[FO])') THEN o_orderstatus END AS o_orderstatus FROM orders_n""")
def regex_validate(spark, sf):
    df = orders_nulls(spark, sf).select("o_orderkey", "priority_n", "o_orderstatus")
    return C.regex_validate(df, REGEX)


@query("validate_rows", f"""WITH {ORDERS_N} SELECT o_orderkey, CAST(len(e) AS BIGINT) AS n_errors, array_to_string(e, '|') AS errors FROM
  (SELECT o_orderkey, list_filter([CASE WHEN bad_num IS NOT NULL AND TRY_CAST(bad_num AS DOUBLE) IS NULL THEN 'bad_num: not a number' END,
     CASE WHEN price_n IS NULL THEN 'price_n: missing value' END], lambda x: x IS NOT NULL) AS e FROM orders_n)""")
def validate_rows(spark, sf):
    v = C.validate_rows(orders_nulls(spark, sf), ["bad_num"], ["price_n"])
    return v.select("o_orderkey", F.size("errors").cast("bigint").alias("n_errors"),
                    F.concat_ws("|", "errors").alias("errors"))
