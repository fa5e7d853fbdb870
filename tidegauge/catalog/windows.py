"""Ordering operators that split a key: ranks, running sums, previous values, shares."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import r6, ts
from tidegauge.operators import windows as wi
from tidegauge.plans import standins as st


@query("split_rank_per_key", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events")
def _(spark, sf):
    e = st.table(spark, sf, "events")
    return wi.chunked_rank(e, ["event_type"], [F.col("ts").asc(), F.col("event_id").asc()], "place").select("event_id", "event_type", "place")


@query("split_running_sum", f"SELECT event_id, {r6('sum(value) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING)')} AS running FROM events")
def _(spark, sf):
    e = st.table(spark, sf, "events")
    return wi.chunked_running_sum(e, ["event_type"], [F.col("ts").asc()], "value", "running").select("event_id", "running")


@query("split_previous_row", f"SELECT event_id, {ts('lag(ts) OVER w')} AS prev_ts, {r6('lag(value) OVER w')} AS prev_value FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)")
def _(spark, sf):
    e = st.table(spark, sf, "events")
    return wi.chunked_lag(e, ["event_type"], ["ts"], ["ts", "value"]).select("event_id", "prev_ts", "prev_value")


@query("split_global_rank", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem")
def _(spark, sf):
    li = st.table(spark, sf, "lineitem")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc(), F.col("l_partkey").asc()]
    return wi.global_rank(li, order, "place").select("l_orderkey", "l_linenumber", "place")


@query("latest_row_per_key", f"SELECT l_partkey, l_orderkey, l_linenumber, {ts('l_shipdate')} AS l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY lineitem.l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1")
def _(spark, sf):
    li = st.table(spark, sf, "lineitem")
    return wi.best(li, ["l_partkey"], [F.col("l_shipdate").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber").desc()]).select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")


@query("top_rows_per_key", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def _(spark, sf):
    return wi.top_n(st.table(spark, sf, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 3, "place").select("o_custkey", "o_orderkey", "place")


@query("duplicate_removal", "SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, sf):
    d = st.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return wi.best(d, ["h"], [F.col("doc_id").asc()]).select("h", "doc_id")


@query("modal_label", "SELECT p_brand, p_name AS label FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, length(p_name) DESC, p_name) = 1")
def _(spark, sf):
    return wi.modal_label(st.table(spark, sf, "part"), ["p_brand"], "p_name", "label")


@query("share_of_maximum", f"SELECT o_orderkey, {r6('o_totalprice / (SELECT max(o_totalprice) FROM orders) * 100')} AS of_max, {r6('o_totalprice / (SELECT sum(o_totalprice) FROM orders) * 100')} AS of_total FROM orders")
def _(spark, sf):
    o = st.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return wi.share_of_total(wi.normalise_to_max(o, "o_totalprice", "of_max"), "o_totalprice", "of_total").drop("o_totalprice")
