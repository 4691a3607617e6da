"""Queries over the order tables: derived columns, matrices, profiles, class tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.lexicons import WESTERN
from ..operators import columns as C
from ..operators import compare as K
from ..operators import features as E
from ..operators import profile as H
from ..operators import ranks as R
from ..operators import scaling as S
from .base import query, r6, table
from .text import FEATURE_CTE, feature_table, rounded_features

# --------------------------------------------------------------------------
# Campaign-like base tables. Orders play campaigns: the price is the money
# collected, the customer's balance the goal, "F" the success flag.
# --------------------------------------------------------------------------
DEALS = """deals AS (SELECT o_orderkey AS id, o_totalprice AS collected, c_acctbal AS goal, o_orderdate AS start_at,
  o_orderpriority AS tag, c_mktsegment AS segment, c_nationkey AS nationkey, (o_orderstatus='F')::INT AS y
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def deals(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_totalprice").alias("collected"),
        F.col("o_orderdate").alias("start_at"), F.col("o_orderpriority").alias("tag"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("goal"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nationkey"))
    return orders.join(customers, "o_custkey").drop("o_custkey")


LINES = """lines AS (SELECT l_orderkey AS okey, l_quantity AS qty, l_extendedprice AS price,
  nullif(l_discount,0) AS disc, l_tax AS tax, (l_returnflag='R')::INT AS y, l_linenumber AS line,
  l_returnflag AS flag, CASE WHEN l_linenumber<7 THEN l_linestatus END AS status FROM lineitem)"""


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("okey"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("disc"), F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linenumber") < 7, F.col("l_linestatus")).alias("status"))


NUMS = ["qty", "price", "disc", "tax"]


def union_sql(template: str, items) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in items)


LONG = "long AS (" + union_sql("SELECT '{c}' AS feature, {c}::DOUBLE AS value, y, status FROM lines WHERE {c} IS NOT NULL",
                               NUMS) + ")"


# --------------------------------------------------------------------------
# Derived columns
# --------------------------------------------------------------------------
@query("funding_ratio", f"WITH {DEALS} SELECT id, round(collected/nullif(goal,0),6)+0.0 AS funding_ratio FROM deals")
def funding_ratio(spark, sf):
    return deals(spark, sf).select("id", r6(C.funding_ratio("collected", "goal")).alias("funding_ratio"))


@query("is_successful", f"WITH {DEALS} SELECT id, (collected/nullif(goal,0)>=1)::INT AS is_successful FROM deals")
def is_successful(spark, sf):
    return deals(spark, sf).select("id", C.is_successful(C.funding_ratio("collected", "goal")).alias("is_successful"))


@query("duration_days", """SELECT o_orderkey AS id, l_linenumber AS line, l_partkey AS part,
  round((epoch_us(l_shipdate)-epoch_us(o_orderdate))/86400000000.0,6)+0.0 AS campaign_duration_days
FROM orders JOIN lineitem ON o_orderkey=l_orderkey""")
def duration_days(spark, sf):
    joined = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        r6(C.duration_days("o_orderdate", "l_shipdate")).alias("campaign_duration_days"))


@query("text_lengths", r"""SELECT doc_id, length(text)::INT AS description_len_chars,
  len(regexp_extract_all(text,'[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))::INT
  AS description_word_count FROM documents""")
def text_lengths(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", C.text_len_chars("text").alias("description_len_chars"),
        C.text_word_count("text").alias("description_word_count"))


@query("has_link_word", r"""SELECT page_id, regexp_matches(url,'(?i)https://|www\.')::INT AS has_link,
  regexp_matches(html,'(?i)\btoken\b|www\.')::INT AS description_has_link_word FROM pages""")
def has_link_word(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", C.has_link_word("url", r"(?i)https://|www\.").alias("has_link"),
        C.has_link_word("html", r"(?i)\btoken\b|www\.").alias("description_has_link_word"))


@query("category_grouped", f"""WITH {DEALS},
m AS (SELECT n_nationkey AS tag, r_name AS category FROM nation JOIN region ON n_regionkey=r_regionkey
      WHERE r_name IN ('ASIA','EUROPE'))
SELECT id, coalesce(category,'Other') AS category_grouped FROM deals LEFT JOIN m ON nationkey=m.tag""")
def category_grouped(spark, sf):
    mapping = (
        table(spark, sf, "nation").join(
            table(spark, sf, "region").where(F.col("r_name").isin("ASIA", "EUROPE")),
            F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("tag"), F.col("r_name").alias("category")))
    return C.category_grouped(deals(spark, sf), "nationkey", mapping).select("id", "category_grouped")


@query("log1p_clip", f"""WITH {DEALS}
SELECT id, round(ln(1+CASE WHEN goal<0 THEN 0 ELSE goal END),6)+0.0 AS log_goal,
       round(ln(1+coalesce(collected,0)),6)+0.0 AS log_text_length FROM deals""")
def log1p_clip(spark, sf):
    return deals(spark, sf).select(
        "id", r6(C.log1p_clip("goal")).alias("log_goal"), r6(C.log1p_filled("collected")).alias("log_text_length"))


@query("flag_positive", f"WITH {DEALS} SELECT id, (coalesce(goal,0)>0)::INT AS has_video FROM deals")
def flag_positive(spark, sf):
    return deals(spark, sf).select("id", C.flag_positive("goal").alias("has_video"))


@query("clip_lower", f"""WITH {DEALS}
SELECT id, round(CASE WHEN collected/nullif(goal,0)<0 THEN 0 ELSE collected/nullif(goal,0) END,6)+0.0 AS funding_pct
FROM deals""")
def clip_lower(spark, sf):
    return deals(spark, sf).select(
        "id", r6(C.clip_lower(C.funding_ratio("collected", "goal"))).alias("funding_pct"))


@query("prepare_campaigns", f"""WITH {DEALS},
p AS (SELECT id, y, ln(1+CASE WHEN goal<0 THEN 0 ELSE goal END) AS log_goal, ln(1+length(tag)) AS log_text_length,
  (nationkey>0)::INT AS has_video,
  CASE WHEN collected/nullif(goal,0)<0 THEN 0 ELSE collected/nullif(goal,0) END AS funding_pct FROM deals)
SELECT id, round(log_goal,6)+0.0 AS log_goal, round(log_text_length,6)+0.0 AS log_text_length, has_video,
  round(funding_pct,6)+0.0 AS funding_pct, round(ln(1+funding_pct),6)+0.0 AS log_funding_pct FROM p""")
def prepare_campaigns(spark, sf):
    raw = deals(spark, sf).withColumns({
        "funding_ratio": C.funding_ratio("collected", "goal"), "tag_len": F.length("tag")})
    out = C.prepare_campaigns(raw, "goal", "tag_len", "nationkey", "funding_ratio", log_target=True)
    return out.select("id", "has_video", *[
        r6(c).alias(c) for c in ("log_goal", "log_text_length", "funding_pct", "log_funding_pct")])


# --------------------------------------------------------------------------
# Matrix preparation
# --------------------------------------------------------------------------
@query("one_hot", f"""WITH {DEALS} SELECT id, {', '.join(
    f"(tag='{v}')::INT AS \"cat_{v}\"" for v in ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))} FROM deals""")
def one_hot(spark, sf):
    return C.one_hot(deals(spark, sf).select("id", "tag"), "tag").drop("tag")


@query("one_hot_baseline", f"""WITH {DEALS} SELECT id, {', '.join(
    f"(segment='{v}')::INT AS \"cat_{v}\"" for v in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'))}
FROM deals""")
def one_hot_baseline(spark, sf):
    return C.one_hot(deals(spark, sf).select("id", "segment"), "segment", baseline="MACHINERY").drop("segment")


@query("to_matrix", f"""WITH {DEALS}
SELECT id, coalesce(try_cast(substr(tag,1,1) AS DOUBLE),0) AS tag_no, coalesce(try_cast(segment AS DOUBLE),0) AS segment,
       round(coalesce(goal,0),6)+0.0 AS goal FROM deals""")
def to_matrix(spark, sf):
    raw = deals(spark, sf).withColumn("tag_no", F.substring("tag", 1, 1))
    out = C.to_matrix(raw, ["tag_no", "segment", "goal", "absent"], ["id"])
    return out.select("id", "tag_no", "segment", r6("goal").alias("goal"))


@query("drop_constant", f"WITH {DEALS} SELECT id, round(goal,6)+0.0 AS goal, y FROM deals")
def drop_constant(spark, sf):
    wide = deals(spark, sf).select("id", r6("goal").alias("goal"), "y", F.lit(1).alias("one"),
                                   F.lit(None).cast("double").alias("nothing"))
    return C.drop_constant(wide, ["goal", "y", "one", "nothing"])


@query("add_intercept", f"WITH {DEALS} SELECT id, 1.0::DOUBLE AS const FROM deals")
def add_intercept(spark, sf):
    return C.add_intercept(deals(spark, sf).select("id"))


@query("zscore", f"""WITH {DEALS}
SELECT id, round((goal-avg(goal) OVER ())/stddev_pop(goal) OVER (),6)+0.0 AS goal FROM deals""")
def zscore(spark, sf):
    return S.zscore(deals(spark, sf).select("id", "goal"), ["goal"]).select("id", r6("goal").alias("goal"))


_R = ("readability_flesch", "readability_fog", "readability_lix", "readability_avg")


@query("scaler_parameters", f"""WITH {FEATURE_CTE} {union_sql(
    "SELECT '{c}' AS feature, round(avg({c}),6)+0.0 AS mean, round(stddev_pop({c}),6)+0.0 AS std, "
    "count({c}) AS count FROM feat", _R)}""")
def scaler_parameters(spark, sf):
    scaler = S.Scaler().fit(feature_table(spark, sf))
    return scaler.summary(spark).select("feature", r6("mean").alias("mean"), r6("std").alias("std"), "count")


_SPLIT = f"""{DEALS},
sized AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(id||'|42'), id) AS rn,
                 count(*) OVER (PARTITION BY y) AS nc, count(*) OVER () AS n FROM deals),
cls AS (SELECT DISTINCT y, nc, n, ceil(n*0.2) AS nt FROM sized),
quota AS (SELECT y, floor(nt*nc/n) + (row_number() OVER (ORDER BY nt*nc/n-floor(nt*nc/n) DESC, y)
          <= max(nt) OVER () - sum(floor(nt*nc/n)) OVER ())::INT AS q FROM cls),
split AS (SELECT s.*, (rn<=q)::INT AS is_test FROM sized s JOIN quota USING (y))"""


@query("train_test_split", f"WITH {_SPLIT} SELECT id, y, is_test FROM split")
def train_test_split(spark, sf):
    return C.train_test_split(deals(spark, sf), "id", "y").select("id", "y", "is_test")


@query("scale_on_train", f"""WITH {_SPLIT},
p AS (SELECT avg(goal) AS m, stddev_pop(goal) AS s FROM split WHERE is_test=0)
SELECT id, is_test, round((goal-m)/s,6)+0.0 AS goal FROM split, p""")
def scale_on_train(spark, sf):
    split = C.train_test_split(deals(spark, sf), "id", "y").select("id", "goal", "is_test")
    train, test, _ = S.scale_on_train(split.where("is_test = 0"), split.where("is_test = 1"), ["goal"])
    return train.unionByName(test).select("id", "is_test", r6("goal").alias("goal"))


@query("fold_assign", f"""WITH {DEALS}
SELECT id, ((row_number() OVER (PARTITION BY y ORDER BY md5(id||'|42'), id)-1)%5)::INT AS fold FROM deals""")
def fold_assign(spark, sf):
    return C.fold_assign(deals(spark, sf), "id", "y").select("id", "fold")


@query("balanced_weights", f"""WITH {DEALS}
SELECT id, round(count(*) OVER ()/(2.0*count(*) OVER (PARTITION BY y)),6)+0.0 AS weight FROM deals""")
def balanced_weights(spark, sf):
    return C.balanced_weights(deals(spark, sf), "y").select("id", r6("weight").alias("weight"))


@query("quantile_codes", f"""WITH {DEALS},
e AS (SELECT quantile_cont(goal,0.25) AS a, quantile_cont(goal,0.5) AS b, quantile_cont(goal,0.75) AS c FROM deals)
SELECT id, (goal>a)::INT+(goal>b)::INT+(goal>c)::INT AS goal_bin FROM deals, e""")
def quantile_codes(spark, sf):
    return C.quantile_codes(deals(spark, sf), "goal").select("id", "goal_bin")


@query("feature_sets", f"""SELECT 'A (controls + cat)' AS set, 'log_goal' AS feature UNION ALL
SELECT 'A (controls + cat)', 'has_video' UNION ALL SELECT 'A (controls + cat)', 'cat_' || v FROM (
  SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority > (SELECT min(o_orderpriority) FROM orders))
UNION ALL SELECT 'C (controls + cat + text)', 'log_goal' UNION ALL SELECT 'C (controls + cat + text)', 'has_video'
UNION ALL SELECT 'C (controls + cat + text)', 'cat_' || v FROM (
  SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority > (SELECT min(o_orderpriority) FROM orders))""")
def feature_sets(spark, sf):
    wide = C.one_hot(deals(spark, sf), "tag").withColumns({
        "log_goal": C.log1p_clip("goal"), "has_video": C.flag_positive("nationkey")})
    rows = [(name, c) for name, cols in C.feature_sets(wide).items() for c in cols]
    return spark.createDataFrame(rows, "set string, feature string")


# --------------------------------------------------------------------------
# Ranks and quantiles
# --------------------------------------------------------------------------
@query("average_rank", f"""WITH {LINES}, {LONG}
SELECT DISTINCT feature, value, count(*) OVER w AS n,
  (rank() OVER (PARTITION BY feature ORDER BY value)) + (count(*) OVER w - 1)/2.0::DOUBLE AS rank
FROM long WINDOW w AS (PARTITION BY feature, value)""")
def average_rank(spark, sf):
    cum = R.cumulate(R.melt_numeric(lines(spark, sf), NUMS), ["feature"])
    return R.average_ranks(cum).select("feature", "value", "n", "rank")


@query("exact_quantiles", f"""WITH {LINES}, {LONG}
SELECT feature, round(quantile_cont(value,0.1),6)+0.0 AS p10, round(quantile_cont(value,0.5),6)+0.0 AS p50,
       round(quantile_cont(value,0.99),6)+0.0 AS p99 FROM long GROUP BY 1""")
def exact_quantiles(spark, sf):
    cum = R.cumulate(R.melt_numeric(lines(spark, sf), NUMS), ["feature"])
    out = R.quantiles(cum, ["feature"], {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return out.select("feature", *[r6(c).alias(c) for c in ("p10", "p50", "p99")])


# --------------------------------------------------------------------------
# Profile
# --------------------------------------------------------------------------
_OV = {"id": "bigint", "collected": "double", "start_at": "timestamp", "tag": "string", "goal": "double",
       "segment": "string", "nationkey": "int", "y": "int"}


@query("overview", "WITH " + DEALS + union_sql(
    """ SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, count(*)-count({c}) AS n_missing,
    round((count(*)-count({c}))*100.0/count(*),2)::DOUBLE AS pct_missing,
    CASE WHEN '{c}' IN ('id','tag','segment','y','nationkey') THEN arg_min({c}::VARCHAR, id) END AS sample
    FROM deals""", _OV))
def overview(spark, sf):
    out = H.overview(deals(spark, sf), "id")
    plain = F.col("column").isin("id", "tag", "segment", "y", "nationkey")
    return out.select("column", "n_unique", "n_missing", "pct_missing", F.when(plain, F.col("sample")).alias("sample"))


@query("numeric_describe", f"""WITH {LINES}, {LONG}
SELECT feature, count(*) AS count, round(avg(value),4)+0.0 AS mean, round(stddev_samp(value),4)+0.0 AS std,
  round(min(value),4)+0.0 AS min, round(quantile_cont(value,0.25),4)+0.0 AS p25,
  round(quantile_cont(value,0.5),4)+0.0 AS p50, round(quantile_cont(value,0.75),4)+0.0 AS p75,
  round(max(value),4)+0.0 AS max FROM long GROUP BY 1""")
def numeric_describe(spark, sf):
    out = H.numeric_describe(lines(spark, sf), NUMS)
    return out.select("feature", "count", *[
        (F.col(c) + 0.0).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


_TOP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, md5(v) ASC NULLS LAST) AS rank
FROM (SELECT "column", v, count(*) AS count FROM cells GROUP BY 1,2))
SELECT "column", coalesce(v,'nan') AS value, count, rank::INT AS rank FROM ranked WHERE rank<=20"""


@query("categorical_counts", f"""WITH cells AS ({union_sql(
    'SELECT ' + "'{c}'" + ' AS "column", {c} AS v FROM documents', ['text', 'lang', 'source'])}), {_TOP}""")
def categorical_counts(spark, sf):
    return H.categorical_counts(table(spark, sf, "documents"))


@query("category_bars", f"""WITH cells AS ({union_sql(
    'SELECT ' + "'{c}'" + ' AS "column", {c} AS v FROM documents', ['text', 'lang', 'source'])}), {_TOP}""")
def category_bars(spark, sf):
    return H.category_bars(table(spark, sf, "documents"), ["text", "lang", "source"])


@query("missing_report", f"""WITH {LINES} SELECT * FROM ({union_sql(
    'SELECT ' + "'{c}'" + ' AS "column", round((count(*)-count({c}))*100.0/count(*),2)::DOUBLE AS pct_missing FROM lines',
    ['okey', *NUMS, 'y', 'line', 'flag', 'status'])}) WHERE pct_missing>0""")
def missing_report(spark, sf):
    return H.missing_report(lines(spark, sf))


@query("target_balance", f"""WITH {DEALS}
SELECT y::VARCHAR AS class, count(*) AS count, round(count(*)*100.0/sum(count(*)) OVER (),2)::DOUBLE AS pct
FROM deals GROUP BY y""")
def target_balance(spark, sf):
    return H.target_balance(deals(spark, sf), "y")


@query("dataset_meta", f"""WITH {LINES}
SELECT count(*) AS n_rows, 9 AS n_cols, 7 AS n_numeric, 2 AS n_categorical,
  (count(*)-count(disc)+count(*)-count(status))::BIGINT AS n_missing_total FROM lines""")
def dataset_meta(spark, sf):
    return H.dataset_meta(lines(spark, sf))


def _hist_sql(keys: str, bins: str) -> str:
    cols = f"{keys}, feature" if keys else "feature"
    return f"""st AS (SELECT {cols}, min(value) AS lo, max(value) AS hi, count(*) AS n, {bins} AS bins
  FROM long GROUP BY ALL HAVING max(value)>min(value)),
cnt AS (SELECT {cols}, least(floor((value-lo)*bins/(hi-lo))::INT, bins-1) AS bin, count(*) AS count
  FROM long JOIN st USING ({cols}) GROUP BY ALL),
grid AS (SELECT *, unnest(range(bins))::INT AS bin FROM st)
SELECT {cols}, grid.bin AS bin, round(lo+(hi-lo)/bins*grid.bin,6)+0.0 AS edge_lo,
  round(lo+(hi-lo)/bins*(grid.bin+1),6)+0.0 AS edge_hi, coalesce(count,0) AS count,
  round(coalesce(count,0)/(n*(hi-lo)/bins),6)+0.0 AS density
FROM grid LEFT JOIN cnt USING ({cols}, bin)"""


def _rounded_hist(df, keys):
    return df.select(*keys, "feature", "bin", r6("edge_lo").alias("edge_lo"), r6("edge_hi").alias("edge_hi"),
                     "count", r6("density").alias("density"))


@query("histogram", f"WITH {LINES}, {LONG}, {_hist_sql('', 'least(30,greatest(5,count(*)//2))::INT')}")
def histogram(spark, sf):
    return _rounded_hist(H.histogram(lines(spark, sf), NUMS), [])


@query("class_histogram", f"WITH {LINES}, {LONG}, {_hist_sql('y', '15')}")
def class_histogram(spark, sf):
    return _rounded_hist(H.class_histogram(lines(spark, sf), NUMS, "y"), ["y"])


_BOX = """q AS (SELECT y, feature, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.5) AS median,
  quantile_cont(value,0.75) AS q3 FROM long GROUP BY ALL)
SELECT y, feature, round(q1,6)+0.0 AS q1, round(median,6)+0.0 AS median, round(q3,6)+0.0 AS q3,
  round(min(value) FILTER (value>=q1-(q3-q1)*1.5 AND value<=q3+(q3-q1)*1.5),6)+0.0 AS whisker_lo,
  round(max(value) FILTER (value>=q1-(q3-q1)*1.5 AND value<=q3+(q3-q1)*1.5),6)+0.0 AS whisker_hi,
  count(*) FILTER (NOT (value>=q1-(q3-q1)*1.5 AND value<=q3+(q3-q1)*1.5)) AS n_outliers
FROM long JOIN q USING (y, feature) GROUP BY ALL"""


@query("box_stats", f"""WITH x AS (SELECT user_id%2 AS y, value AS value FROM events),
long AS (SELECT y::INT AS y, 'value' AS feature, value FROM x), {_BOX}""")
def box_stats(spark, sf):
    ev = table(spark, sf, "events").select((F.col("user_id") % 2).cast("int").alias("y"), "value")
    out = H.box_stats(ev, ["value"], ["y"])
    return out.select("y", "feature", *[r6(c).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                      "n_outliers")


CORR_COLS = [*NUMS, "y"]
_PAIRS = list(combinations(CORR_COLS, 2))


@query("corr_pearson", f"WITH {LINES} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),4)+0.0 AS r FROM lines" for a, b in _PAIRS))
def corr_pearson(spark, sf):
    out = H.corr_matrix(lines(spark, sf), CORR_COLS, "pearson")
    return out.select("a", "b", (F.col("r") + 0.0).alias("r"))


def _spearman_sql(a, b, dp=4):
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra,rb),{dp})+0.0 AS r FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a})-1)/2.0 AS ra,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b})-1)/2.0 AS rb
  FROM lines WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("corr_spearman", f"WITH {LINES} " + " UNION ALL ".join(_spearman_sql(a, b) for a, b in _PAIRS))
def corr_spearman(spark, sf):
    out = H.corr_matrix(lines(spark, sf), CORR_COLS, "spearman")
    return out.select("a", "b", (F.col("r") + 0.0).alias("r"))


@query("target_corr", f"WITH {LINES}, c AS (" + " UNION ALL ".join(_spearman_sql(a, "y", 6) for a in NUMS) +
       ") SELECT a AS feature, r FROM c")
def target_corr(spark, sf):
    return H.target_corr(lines(spark, sf), NUMS, "y").select("feature", r6("r").alias("r"))


@query("top_corr", f"WITH {LINES}, c AS (" + " UNION ALL ".join(
    _spearman_sql(a, b, 10) for b in ("y", "price") for a in CORR_COLS if a != b) + """)
SELECT b AS target, a AS feature, round(abs(r),4) AS abs_corr_spearman,
  row_number() OVER (PARTITION BY b ORDER BY round(abs(r),4) DESC, a)::INT AS rank FROM c
QUALIFY rank<=3""")
def top_corr(spark, sf):
    return H.top_corr(lines(spark, sf), CORR_COLS, ["y", "price"], top=3)


@query("group_stats", f"""WITH {LINES}, {LONG}
SELECT y, feature, round(avg(value),6)+0.0 AS mean, round(median(value),6)+0.0 AS median,
  round(stddev_samp(value),6)+0.0 AS std, count(*) AS count FROM long GROUP BY ALL""")
def group_stats(spark, sf):
    return H.group_stats(lines(spark, sf), NUMS, "y").select(
        "y", "feature", *[r6(c).alias(c) for c in ("mean", "median", "std")], "count")


@query("linear_trend", f"WITH {LINES} " + union_sql(
    "SELECT '{c}' AS feature, round(regr_slope(price,{c}),6)+0.0 AS slope, "
    "round(regr_intercept(price,{c}),4)+0.0 AS intercept, regr_count(price,{c})::BIGINT AS n FROM lines",
    ["qty", "disc", "tax"]))
def linear_trend(spark, sf):
    return H.linear_trend(lines(spark, sf), ["qty", "disc", "tax"], "price").select(
        "feature", r6("slope").alias("slope"), (F.round("intercept", 4) + 0.0).alias("intercept"), "n")


@query("success_rate", f"""WITH {DEALS}
SELECT tag, round(avg(y),6)+0.0 AS mean, count(y) AS count FROM deals GROUP BY 1 ORDER BY avg(y) DESC, tag LIMIT 20""")
def success_rate(spark, sf):
    return H.success_rate(deals(spark, sf), "tag", "y").select("tag", r6("mean").alias("mean"), "count")


@query("profile_report")
def profile_report(spark, sf):
    """Row count of every table the composite report holds."""
    report = H.profile_report(lines(spark, sf), "okey", "y", "price", skip=["okey"])
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("path"), "n_rows")
              for name, df in report.items()]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


# --------------------------------------------------------------------------
# Class comparisons
# --------------------------------------------------------------------------
_T_FEATURES = ["social_score", "gratitude_score", "we_count", "certainty_score", "uncertainty_score",
               "number_density", "readability_flesch", "readability_avg"]
_LABELED = f"""{FEATURE_CTE}, lab AS (SELECT feat.*, quality AS y FROM feat JOIN labels USING (doc_id)),
tl AS ({union_sql("SELECT '{c}' AS feature, {c}::DOUBLE AS value, y FROM lab WHERE {c} IS NOT NULL", _T_FEATURES)})"""


def labeled_features(spark, sf):
    """Features of the labelled documents; the join comes first, so others cost nothing."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    docs = table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")
    return rounded_features(E.extract_text_features(docs, "text", WESTERN), "doc_id", "y")


@query("class_location", f"""WITH {_LABELED}
SELECT feature, count(*) FILTER (y=1) AS n_success, count(*) FILTER (y=0) AS n_fail,
  round(median(value) FILTER (y=1),6)+0.0 AS median_success, round(median(value) FILTER (y=0),6)+0.0 AS median_fail,
  round(avg(value) FILTER (y=1),6)+0.0 AS mean_success, round(avg(value) FILTER (y=0),6)+0.0 AS mean_fail
FROM tl GROUP BY 1""")
def class_location(spark, sf):
    return K.class_location(labeled_features(spark, sf), _T_FEATURES, "y").select(
        "feature", "n_success", "n_fail",
        *[r6(c).alias(c) for c in ("median_success", "median_fail", "mean_success", "mean_fail")])


_MWU = """rk AS (SELECT feature, y, value, rank() OVER (PARTITION BY feature ORDER BY value)
       + (count(*) OVER (PARTITION BY feature, value)-1)/2.0::DOUBLE AS r,
       count(*) OVER (PARTITION BY feature, value)::DOUBLE AS t FROM tl),
s AS (SELECT feature, count(*) FILTER (y=1)::DOUBLE AS n1, count(*) FILTER (y=0)::DOUBLE AS n0,
       sum(r) FILTER (y=1) AS r1, sum(t*t-1) AS ties FROM rk GROUP BY 1),
mw AS (SELECT *, r1-n1*(n1+1)/2 AS u,
       sqrt(n1*n0/12*((n1+n0+1)-ties/((n1+n0)*(n1+n0-1)))) AS sigma FROM s)"""


@query("mann_whitney", f"""WITH {_LABELED}, {_MWU}
SELECT feature, n1::BIGINT AS n_success, n0::BIGINT AS n_fail, u AS "mw_U",
  round((abs(u-n1*n0/2)-0.5)/sigma,6)+0.0 AS mw_z FROM mw""")
def mann_whitney(spark, sf):
    return K.mann_whitney(labeled_features(spark, sf), _T_FEATURES, "y", p_value=False).select(
        "feature", "n_success", "n_fail", "mw_U", r6("mw_z").alias("mw_z"))


@query("rank_biserial", f"""WITH {LINES}, tl AS (SELECT feature, value, y FROM ({union_sql(
    "SELECT '{c}' AS feature, {c}::DOUBLE AS value, y FROM lines WHERE {c} IS NOT NULL", NUMS)})), {_MWU}
SELECT feature, round(1-2*u/(n1*n0),6)+0.0 AS rank_biserial_r FROM mw""")
def rank_biserial(spark, sf):
    return K.mann_whitney(lines(spark, sf), NUMS, "y", p_value=False).select(
        "feature", r6("rank_biserial_r").alias("rank_biserial_r"))


@query("point_biserial", f"""WITH {_LABELED}
SELECT feature, round(corr(y,value),6)+0.0 AS pointbiserial_r FROM tl GROUP BY 1""")
def point_biserial(spark, sf):
    return K.point_biserial(labeled_features(spark, sf), _T_FEATURES, "y", p_value=False).select(
        "feature", r6("pointbiserial_r").alias("pointbiserial_r"))


@query("test_table")
def test_table(spark, sf):
    return K.test_table(labeled_features(spark, sf), _T_FEATURES, "y")


@query("test_table_statistics", f"""WITH {_LABELED}, {_MWU},
loc AS (SELECT feature, round(median(value) FILTER (y=1),6)+0.0 AS median_success,
  round(avg(value) FILTER (y=0),6)+0.0 AS mean_fail, round(corr(y,value),6)+0.0 AS pointbiserial_r FROM tl GROUP BY 1)
SELECT mw.feature AS feature, n1::BIGINT AS n_success, n0::BIGINT AS n_fail, median_success, mean_fail, u AS "mw_U",
  round(1-2*u/(n1*n0),6)+0.0 AS rank_biserial_r, pointbiserial_r FROM mw JOIN loc USING (feature)""")
def test_table_statistics(spark, sf):
    return K.test_table(labeled_features(spark, sf), _T_FEATURES, "y").select(
        "feature", "n_success", "n_fail", r6("median_success").alias("median_success"), r6("mean_fail").alias("mean_fail"),
        "mw_U", r6("rank_biserial_r").alias("rank_biserial_r"), r6("pointbiserial_r").alias("pointbiserial_r"))
