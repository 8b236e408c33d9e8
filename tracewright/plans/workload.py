"""The registered queries over the driver's tables, each beside its DuckDB SQL.

Each maps one of the library's operators to those tables, whole: suppliers stand for components, line items for pads,
parts for nets, orders for links, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, params, text, units
from ..operators import dedup, diff, documents, flatten, graph, lint, netlist, ordering, reports, resolve, spatial

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT net, count(*) AS n_conn, string_agg(designator || '-' || pad, ' ' ORDER BY designator, pad) AS members
FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS net, 'S' || l_suppkey AS designator, CAST(l_linenumber AS VARCHAR) AS pad FROM lineitem)
GROUP BY net""")
def net_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    pads = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("net"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("designator"), F.col("l_linenumber").cast("string").alias("pad"))
    return netlist.group_by_net(pads).select("net", "n_conn", netlist.members_text(F.col("members")).alias("members"))


@query("""
SELECT c_mktsegment, c_custkey, c_name, c_nationkey FROM (
  SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) WHERE n = 1""")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name", "c_nationkey")
    return resolve.first_by(rows, ["c_mktsegment"], ["c_custkey"])


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def positional_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.positional(t(spark, sf_dir, "nation"), "n_regionkey", t(spark, sf_dir, "region"), "r_regionkey", "r_name", "r_name")
    return found.select("n_nationkey", "n_name", "r_name")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def free_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.unmatched(t(spark, sf_dir, "documents").select("doc_id", "source"), t(spark, sf_dir, "labels"), ["doc_id"])


@query("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent
FROM conversations""")
def preceding_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return resolve.preceding(rows, ["conv_id"], ["turn"], F.col("role") == "user", "turn", "parent")


@query("""
SELECT c_custkey, designator, row_number() OVER (ORDER BY upper(regexp_extract(designator, '^(.*?)[0-9]*$', 1)),
  CAST(regexp_extract(designator, '([0-9]+)$', 1) AS HUGEINT), c_custkey) AS place
FROM (SELECT c_custkey, left(c_mktsegment, 1) || (c_custkey % 1000) AS designator FROM customer)""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.substring("c_mktsegment", 1, 1), (F.col("c_custkey") % 1000).cast("string")).alias("designator"))
    return ordering.global_rank(rows, [*text.natural_key(F.col("designator")), "c_custkey"], "place").select("c_custkey", "designator", "place")


@query("""
SELECT n_nationkey, p_partkey, p_size FROM (
  SELECT n_nationkey, p_partkey, p_size, row_number() OVER (PARTITION BY n_nationkey ORDER BY abs(p_size - 2 * n_nationkey), p_partkey) AS n
  FROM nation JOIN part ON abs(p_size - 2 * n_nationkey) <= 2) WHERE n = 1""")
def top_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = resolve.first_by(t(spark, sf_dir, "part").select("p_size", "p_partkey"), ["p_size"], ["p_partkey"])  # of a place, only the first counts
    near = spatial.near_join(t(spark, sf_dir, "nation").select("n_nationkey"), nodes, [], F.col("n_nationkey") * 2, F.col("p_size"), 2)
    best = F.min(F.struct(F.abs(F.col("p_size") - 2 * F.col("n_nationkey")).alias("d"), "p_partkey", "p_size")).alias("b")
    return near.groupBy("n_nationkey").agg(best).select("n_nationkey", "b.p_partkey", "b.p_size")


@query("""
SELECT a.event_id, b.event_id AS mark_id, b.us - a.us AS gap FROM
  (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type <> 'signup') a
  JOIN (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'signup') b ON abs(a.us - b.us) <= 60000000""")
def snap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events").select("event_id", "event_type", F.expr("unix_micros(cast(ts as timestamp))").alias("us"))
    marks = events.where("event_type = 'signup'").select(F.col("event_id").alias("mark_id"), F.col("us").alias("mark_us"))
    near = spatial.near_join(events.where("event_type <> 'signup'"), marks, [], F.col("us"), F.col("mark_us"), 60_000_000)
    return near.select("event_id", "mark_id", (F.col("mark_us") - F.col("us")).alias("gap"))


@query("""
WITH c AS (
  SELECT s_suppkey, min(c_custkey) AS c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey
  AND abs(CAST(round(s_acctbal * 100) AS BIGINT) - CAST(round(c_acctbal * 100) AS BIGINT)) <= 20000 GROUP BY s_suppkey)
SELECT min(s_suppkey) AS s_suppkey, c_custkey FROM c GROUP BY c_custkey""")
def pair_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    regions = t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), cents("s_acctbal").alias("s"))
    pads = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), cents("c_acctbal").alias("c"))
    return spatial.pair_once(spatial.near_join(regions, pads, ["nation"], F.col("s"), F.col("c"), 20_000), "s_suppkey", "c_custkey")


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the customer's order before it."""
    from pyspark.sql import Window as W

    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", before.alias("before"))


_CHAINS = "links AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)"


@query(f"WITH {_CHAINS} SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM links")
def conn_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _chains(spark, sf_dir).select("o_orderkey", F.coalesce("before", "o_orderkey").alias("before"))
    return graph.components(links, "o_orderkey", "before")


@query("""
WITH nets AS (SELECT o_custkey AS root, min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS k FROM orders GROUP BY o_custkey)
SELECT root, CASE WHEN k IS NOT NULL THEN 'P' || k ELSE 'N' || lpad(CAST(row_number() OVER (PARTITION BY k IS NULL ORDER BY root) AS VARCHAR), 5, '0') END AS name FROM nets""")
def name_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "root")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("P"), F.col("o_orderkey").cast("string")))
    candidates = orders.select("root", F.lit(0).alias("priority"), F.col("o_orderkey").alias("ord"), name.alias("name"))
    return netlist.name_roots(candidates, orders.select("root").distinct(), ["root"])


@query("""
SELECT name, count(*) AS n_members FROM (
  SELECT DISTINCT CASE WHEN p_size > 45 THEN 'N' || CAST(p_retailprice AS INTEGER) ELSE p_brand END AS name, p_type, p_name FROM part)
GROUP BY name HAVING NOT starts_with(name, 'N') OR count(*) >= 2""")
def merge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") > 45, F.concat(F.lit("N"), F.rint("p_retailprice").cast("int").cast("string"))).otherwise(F.col("p_brand"))
    return netlist.merge_by_name(t(spark, sf_dir, "part").select(name.alias("name"), F.col("p_type").alias("designator"), F.col("p_name").alias("pad")), F.startswith("name", F.lit("N")))


@query("""
WITH r AS (SELECT r_regionkey, 1000 * r_regionkey AS x, 100 AS y, r_regionkey % 4 AS k FROM region),
n AS (
  SELECT n_nationkey, n_regionkey, k AS k1, (k + n_nationkey) % 4 AS k2,
         x + CASE k WHEN 0 THEN 50 * n_nationkey WHEN 1 THEN -7 WHEN 2 THEN -50 * n_nationkey ELSE 7 END AS x,
         y + CASE k WHEN 0 THEN 7 WHEN 1 THEN 50 * n_nationkey WHEN 2 THEN -7 ELSE -50 * n_nationkey END AS y
  FROM nation JOIN r ON r_regionkey = n_regionkey)
SELECT s_suppkey, CAST(n.x + CASE k2 WHEN 0 THEN s_suppkey WHEN 1 THEN -3 WHEN 2 THEN -s_suppkey ELSE 3 END AS INTEGER) AS x,
       CAST(n.y + CASE k2 WHEN 0 THEN 3 WHEN 1 THEN s_suppkey WHEN 2 THEN -3 ELSE -s_suppkey END AS INTEGER) AS y
FROM supplier JOIN n ON n_nationkey = s_nationkey""")
def flatten_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    def placed(df: DataFrame, parent, child, ord_col, x, y, k) -> DataFrame:
        one, zero = F.lit(1), F.lit(0.0)
        cols = {"parent": parent, "child": child, "ord": ord_col.cast("int"), "x": x.cast("double"), "y": y.cast("double"), "rotation": (k % 4 * 90).cast("double"), "mirror": F.lit(False), "cols": one, "rows": one, "dx": zero, "dy": zero, "origin_x": zero, "origin_y": zero}
        return df.select(*(v.alias(n) for n, v in cols.items()))

    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    regions = placed(t(spark, sf_dir, "region"), F.lit("panel"), F.concat(F.lit("r"), r.cast("string")), r, r * 1000, F.lit(100), r)
    nations = placed(t(spark, sf_dir, "nation"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), n.cast("string")), n, n * 50, F.lit(7), n)
    found, _ = flatten.instances(regions.unionByName(nations), spark.range(1).select(F.lit("panel").alias("doc")))
    pads = t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("doc"))
    x, y = flatten.applied(F.col("s_suppkey").cast("double"), F.lit(3.0))
    return pads.join(found, "doc").select("s_suppkey", x.alias("x"), y.alias("y"))


@query("""
SELECT c_nationkey, CAST(min(x) AS INTEGER) AS x_min, CAST(min(y) AS INTEGER) AS y_min, CAST(max(x) AS INTEGER) AS x_max, CAST(max(y) AS INTEGER) AS y_max FROM (
  SELECT c_nationkey, least(2147483647, greatest(-2147483648, CAST(round(c_acctbal * 100) AS BIGINT) * 4000)) AS x, c_custkey AS y FROM customer)
GROUP BY c_nationkey""")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.round(F.col("c_acctbal") * 100).cast("bigint") * 4000, F.col("c_custkey")
    return spatial.bounds(t(spark, sf_dir, "customer"), ["c_nationkey"], x, y, x, y)


@query("SELECT p_partkey, p_name AS name, p_brand AS brand, p_size AS size, p_size > 25 AS large, 4 AS n_params FROM part")
def param_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.concat(F.lit("|NAME="), F.col("p_name"), F.lit("|Brand="), F.col("p_brand"), F.lit("|SIZE= "), F.col("p_size").cast("string"), F.lit("|LARGE="), F.when(F.col("p_size") > 25, "T").otherwise("F"))
    p = params.parse(F.col("record"))
    rows = t(spark, sf_dir, "part").select("p_partkey", record.alias("record")).select("p_partkey", p.alias("p"))
    c = F.col("p")
    return rows.select("p_partkey", params.first(c, "NAME").alias("name"), params.lookup(c, "BRAND").alias("brand"), params.as_int(params.first(c, "SIZE")).alias("size"), params.as_bool(params.first(c, "LARGE")).alias("large"), F.size("p").alias("n_params"))


@query("""SELECT p_partkey, p_name || ', "' || p_type || '"' AS comment, 'Standard,' || p_size AS kind, p_brand AS brand, 3 AS n_tokens FROM part""")
def csv_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part")
    line = F.concat(F.lit('"Comment='), F.col("p_name"), F.lit(', ""'), F.col("p_type"), F.lit('"""'), F.lit(',"Kind=Standard,'), F.col("p_size").cast("string"), F.lit('",Brand='), F.col("p_brand"))
    parsed = rows.select("p_partkey", params.token_params(params.quoted_tokens(line)).alias("p"))
    p = F.col("p")
    return parsed.select("p_partkey", params.first(p, "Comment").alias("comment"), params.first(p, "kind").alias("kind"), params.first(p, "BRAND").alias("brand"), F.size(p).alias("n_tokens"))


@query("""
SELECT l_orderkey, arg_min(v, ord) FILTER (k = 'A') AS first_a, arg_max(v, ord) FILTER (k = 'A') AS last_a,
       arg_min(v, ord) FILTER (k = 'N') AS first_n, arg_max(v, ord) FILTER (k = 'N') AS last_n
FROM (SELECT l_orderkey, l_returnflag AS k, CAST(l_suppkey AS VARCHAR) AS v, lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '/' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '/' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS ord FROM lineitem)
GROUP BY l_orderkey""")
def kv_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.col("l_returnflag"), F.lit("="), F.col("l_suppkey").cast("string")).alias("kv"))
    record = F.concat(F.lit("|"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["kv"]), "|"))
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(record.alias("record")).select("l_orderkey", params.parse(F.col("record")).alias("p"))
    p = F.col("p")
    return rows.select("l_orderkey", *(f(p, k).alias(f"{n}_{k.lower()}") for k in "AN" for n, f in (("first", params.first), ("last", params.last))))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: ends_with(lines[i], ':') OR length(lines[i]) <= 40) AS heads FROM l)
SELECT doc_id, len(lines) AS n_lines, len(heads) AS n_sections, coalesce(heads[1] - 1, len(lines)) AS preamble,
       coalesce(list_max(list_transform(range(1, len(heads) + 1), lambda i: coalesce(heads[i + 1], len(lines) + 1) - heads[i])), 0) AS longest FROM x""")
def ini_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under headings, within each text: no row leaves its partition."""
    rows = t(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    is_head = lambda s: s.endswith(":") | (F.length(s) <= 40)
    heads = F.filter(F.transform("lines", lambda s, i: F.when(is_head(s), i + 1)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", F.size("lines").alias("n"), heads.alias("heads"))
    after = F.concat(F.slice("heads", F.lit(2), F.greatest(F.size("heads") - 1, F.lit(0))), F.array(F.col("n") + 1))
    longest = F.array_max(F.zip_with("heads", after, lambda a, b: b - a))
    long = lambda c: c.cast("bigint")
    return rows.select("doc_id", long(F.col("n")).alias("n_lines"), long(F.size("heads")).alias("n_sections"), long(F.coalesce(F.get("heads", F.lit(0)) - 1, F.col("n"))).alias("preamble"), long(F.coalesce(F.when(F.size("heads") > 0, longest), F.lit(0))).alias("longest"))


@query("""
SELECT p_partkey, raw, (raw // 10000) || rtrim(rtrim('.' || lpad(CAST(raw % 10000 AS VARCHAR), 4, '0'), '0'), '.') || 'mil' AS mil, raw AS back FROM (
  SELECT p_partkey, CAST(round(p_retailprice * 1000) AS INTEGER) + p_size AS raw FROM part)""")
def coord_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select("p_partkey", (F.round(F.col("p_retailprice") * 1000).cast("int") + F.col("p_size")).alias("raw"))
    rows = rows.withColumn("mil", units.mil_text(F.col("raw")))
    return rows.withColumn("back", units.parse_length(F.col("mil")))


@query("""
SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[,"\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS placement,
       md5(CASE WHEN regexp_matches(text, '[;"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS bom,
       md5(translate(text, chr(9) || chr(10) || chr(13), '   ')) AS tsv FROM documents""")
def csv_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.quote_placement(c)).alias("placement"), F.md5(text.quote_bom(c, ";")).alias("bom"), F.md5(text.plain_tsv(c)).alias("tsv"))


@query("""
SELECT c_custkey, (c_custkey & 4) = 0 AS unlocked, (c_custkey & 8) <> 0 AS shown, CAST(packed & 255 AS INTEGER) AS r, CAST((packed >> 8) & 255 AS INTEGER) AS g,
       CAST((packed >> 16) & 255 AS INTEGER) AS b, '#' || lower(lpad(to_hex(packed & 255), 2, '0') || lpad(to_hex((packed >> 8) & 255), 2, '0') || lpad(to_hex((packed >> 16) & 255), 2, '0')) AS colour
FROM (SELECT c_custkey, (c_custkey * 7919) % 16777216 AS packed FROM customer)""")
def bit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7919 % 16777216).alias("packed"))
    r, g, b = bits.colour_parts(F.col("packed"))
    return rows.select("c_custkey", (~bits.has_bit(F.col("c_custkey"), 4)).alias("unlocked"), bits.has_bit(F.col("c_custkey"), 8).alias("shown"), r.alias("r"), g.alias("g"), b.alias("b"), bits.colour_text(F.col("packed")).alias("colour"))


@query("""
SELECT c_custkey, CAST(CASE WHEN s >= 2147483648 THEN s - 4294967296 ELSE s END AS INTEGER) AS checksum FROM (
  SELECT c_custkey, CAST(list_sum(list_transform(range(0, length(c_name)), lambda i: ascii(substr(c_name, CAST(i + 1 AS BIGINT), 1)) * greatest(i, 1))) AS BIGINT) % 4294967296 AS s FROM customer)""")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").select("c_custkey", bits.weighted_checksum(F.col("c_name").cast("binary")).alias("checksum"))


@query("""
SELECT 'order without lines' AS check, CAST(o_orderkey AS VARCHAR) AS item, 'no line items' AS message FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'dangling part', CAST(l_orderkey AS VARCHAR), 'part does not exist' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'label without document', CAST(doc_id AS VARCHAR), 'document does not exist' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL SELECT 'line count', CAST(o_orderkey AS VARCHAR), 'states 4, has ' || coalesce(n, 0) FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> 4
UNION ALL SELECT 'repeated line', k, 'occurs ' || n || ' times' FROM (SELECT l_orderkey || '/' || l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1) WHERE n > 1""")
def lint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, labels = (t(spark, sf_dir, n) for n in ("orders", "lineitem", "labels"))
    keyed = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    line_key = lines.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line"))
    return lint.report([
        lint.missing(orders, keyed, ["o_orderkey"], "order without lines", "o_orderkey", "no line items"),
        lint.missing(lines.withColumnRenamed("l_partkey", "p_partkey"), t(spark, sf_dir, "part"), ["p_partkey"], "dangling part", "l_orderkey", "part does not exist"),
        lint.missing(labels, t(spark, sf_dir, "documents"), ["doc_id"], "label without document", "doc_id", "document does not exist"),
        lint.wrong_count(orders, keyed, "o_orderkey", F.lit(4), "line count"),
        lint.repeated(line_key, "line", "repeated line"),
    ])


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return orders.where("o_orderpriority <> '1-URGENT'"), orders.where("o_orderpriority <> '5-LOW'").withColumn("o_orderpriority", F.when(F.col("o_orderpriority") == "2-HIGH", "1-URGENT").otherwise(F.col("o_orderpriority")))


_VERSIONS = """a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'),
b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '2-HIGH' THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW')"""


@query(f"""
WITH {_VERSIONS},
j AS (SELECT coalesce(b.o_orderstatus, a.o_orderstatus) AS kind, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus <> b.o_orderstatus OR a.o_orderpriority <> b.o_orderpriority THEN 'changed' END AS what
      FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT kind, count(*) FILTER (what = 'added') AS added, count(*) FILTER (what = 'removed') AS removed, count(*) FILTER (what = 'changed') AS changed FROM j WHERE what IS NOT NULL GROUP BY kind""")
def diff_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changed(*_versions(spark, sf_dir), ["o_orderkey"], "o_orderstatus")


@query("""
WITH a AS (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'),
b AS (SELECT o_orderstatus, CASE WHEN o_orderpriority = '2-HIGH' THEN '1-URGENT' ELSE o_orderpriority END FROM orders WHERE o_orderpriority <> '5-LOW'),
d AS (SELECT *, 1 AS added, 0 AS removed FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 0, 1 FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b))
SELECT o_orderstatus AS kind, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM d GROUP BY 1""")
def diff_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (v.drop("o_orderkey") for v in _versions(spark, sf_dir))
    return diff.multiset(before, after, "o_orderstatus")


@query("""
WITH c AS (SELECT source || '.txt' AS name, sha256(text) AS sha, min(doc_id) AS first, count(*) AS copies FROM documents WHERE text <> '' GROUP BY 1, 2),
v AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first) AS version FROM c)
SELECT name, sha, first, copies, CAST(version AS INTEGER) AS version, CASE WHEN version = 1 THEN name ELSE replace(name, '.txt', '-' || version || '.txt') END AS file FROM v""")
def model_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("source"), F.lit(".txt")).alias("name"), "text")
    return dedup.suffixed(docs, "name", "text", "doc_id")


@query("SELECT o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def stack_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.chain_positions(_chains(spark, sf_dir), "o_orderkey", "before")


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS selected, CAST(len(json_keys(props)) AS INTEGER) AS n_fields FROM events""")
def json_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("event_id", documents.parsed(F.col("props")).alias("d"))
    k = documents.at(F.col("d"), "$.k", "bigint")
    return rows.select("event_id", k.alias("k"), (k > 50).alias("selected"), documents.length(F.col("d")).alias("n_fields"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {n}" for n in _TABLES))
def counts_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts({n: t(spark, sf_dir, n) for n in _TABLES})


@query("""
WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(round(CAST(v AS DOUBLE) * 1000) AS BIGINT)) AS v FROM embeddings)
SELECT vec_id, CAST(list_sum(list_transform(range(1, 33), lambda i: v[2 * i - 1] * v[(2 * i + 1) % 64 + 1] - v[2 * i % 64 + 1] * v[2 * i])) AS BIGINT) AS area2 FROM p""")
def shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda i: F.round(F.get("embedding", i).cast("double") * 1000).cast("bigint")
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: F.struct(raw(i * 2).alias("x"), raw(i * 2 + 1).alias("y")))
    return t(spark, sf_dir, "embeddings").select("vec_id", spatial.doubled_area(points).alias("area2"))


from . import designs  # noqa: E402, F401  registers its queries
