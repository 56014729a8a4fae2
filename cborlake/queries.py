"""The queries of the engine, by name, and their SQL. Outputs are lowercase hexadecimal and BIGINT counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import dynamic
from .operators import canonical, conformance, corpus, generate, registry
from .plans import typed
from .sources import vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan with fewer partitions than cores, as of a file of one row group, are dealt out before Python works on them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < cores else rows


def _hex(item: Column) -> Column:
    return F.lower(F.hex(item))


# pieces of SQL that give hexadecimal text


def _head(major: int, x: str) -> str:
    b = major << 5
    wide = " ".join(f"WHEN ({x}) < {1 << 8 * w}::HUGEINT THEN '{b + 24 + k:02x}' || lpad(lower(to_hex({x})), {2 * w}, '0')" for k, w in enumerate((1, 2, 4)))
    return f"(CASE WHEN ({x}) < 24 THEN lpad(lower(to_hex(({x}) + {b})), 2, '0') {wide} ELSE '{b + 27:02x}' || lpad(lower(to_hex({x})), 16, '0') END)"


def _int(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN {_head(0, x)} ELSE {_head(1, f'(-1 - ({x}))')} END)"


def _text(x: str) -> str:
    return f"({_head(3, f'strlen({x})')} || lower(hex({x})))"


def _key(name: str) -> str:
    return f"'{(bytes([0x60 + len(name)]) + name.encode()).hex()}'"


def _float(x: str) -> str:
    """Of finite numbers, NaN and infinities."""
    bits = f"(CAST(CAST(({x})::DOUBLE AS BIT) AS UBIGINT))"
    e, m = f"((({bits} >> 52) & 2047)::BIGINT - 1023)", f"({bits} & {(1 << 52) - 1}::UBIGINT)::HUGEINT"
    sign = f"(({bits} >> 63)::BIGINT * 32768)"
    single = f"CAST(CAST(({x})::FLOAT AS BIT) AS UINTEGER)"
    return f"""(CASE WHEN isnan({x}) THEN 'f97e00' WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'f97c00' ELSE 'f9fc00' END
      WHEN {x} = 0 THEN 'f9' || lpad(lower(to_hex({sign})), 4, '0')
      WHEN {e} BETWEEN -14 AND 15 AND {m} % {1 << 42} = 0 THEN 'f9' || lpad(lower(to_hex(({sign} + ({e} + 15) * 1024 + {m} // {1 << 42})::BIGINT)), 4, '0')
      WHEN {e} BETWEEN -24 AND -15 AND ({m} + {1 << 52}) % (1::HUGEINT << (28 - {e})::INT) = 0 THEN 'f9' || lpad(lower(to_hex(({sign} + ({m} + {1 << 52}) // (1::HUGEINT << (28 - {e})::INT))::BIGINT)), 4, '0')
      WHEN abs({x}) <= 3.4028234663852886e38 AND ({x})::FLOAT::DOUBLE = ({x})::DOUBLE THEN 'fa' || lpad(lower(to_hex({single})), 8, '0')
      ELSE 'fb' || lpad(lower(to_hex({bits})), 16, '0') END)"""


def _dcbor(x: str) -> str:
    whole = f"(NOT isnan({x}) AND NOT isinf({x}) AND {x} = floor({x}) AND {x} >= -9223372036854775808.0 AND {x} < 18446744073709551616.0)"
    number = f"(CASE WHEN {whole} THEN {x} ELSE 0 END)::HUGEINT"
    return f"(CASE WHEN {whole} THEN {_int(number)} ELSE {_float(x)} END)"


@_query(f"SELECT o_orderkey, {_int('o_orderkey')} AS item FROM orders")
def encode_int_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", _hex(C.encode_int(F.col("o_orderkey"))).alias("item"))


_EDGES = [s * (1 << k) + d for k in (3, 8, 16, 32, 63) for d in (-1, 0, 1) for s in (1, -1)] + [0, 23, 24, -24, -25, (1 << 64) - 1, -(1 << 64)]


@_query(f"SELECT n::VARCHAR AS n, {_int('n')} AS item FROM (SELECT -o_custkey::HUGEINT AS n FROM orders UNION ALL SELECT unnest([{', '.join(f'{n}::HUGEINT' for n in _EDGES)}]))")
def encode_int_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame([(str(n),) for n in _EDGES], "n string").select(F.col("n").cast("decimal(20,0)").alias("n"))
    rows = _table(spark, sf_dir, "orders").select((-F.col("o_custkey")).cast("decimal(20,0)").alias("n")).unionByName(edges)
    return rows.select(F.col("n").cast("string").alias("n"), _hex(C.encode_wide_int(F.col("n"))).alias("item"))


@_query(f"SELECT t, {_text('t')} AS item FROM (SELECT c_name AS t FROM customer UNION ALL SELECT p_name FROM part UNION ALL SELECT unnest(['', 'ü', '水', '𐅑']))")
def encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([("",), ("ü",), ("水",), ("𐅑",)], "t string")
    rows = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("t")).unionByName(_table(spark, sf_dir, "part").select(F.col("p_name").alias("t"))).unionByName(more)
    return rows.select("t", _hex(C.encode_text(F.col("t"))).alias("item"))


@_query(f"SELECT doc_id, sha256({_text('nfc_normalize(text)')}) AS digest FROM documents")
def encode_text_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(_hex(dynamic.encode_text_nfc(F.col("text"))), 256).alias("digest"))


@_query("SELECT c_custkey, '5820' || sha256(c_name) AS item FROM customer")
def encode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", _hex(C.encode_hex(F.sha2("c_name", 256))).alias("item"))


@_query(f"SELECT l_orderkey, l_linenumber, {_float('l_extendedprice')} AS price, {_float('l_discount')} AS discount FROM lineitem")
def encode_float_rfc8949(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _hex(C.encode_float(F.col("l_extendedprice"))).alias("price"), _hex(C.encode_float(F.col("l_discount"))).alias("discount"))


@_query(f"SELECT l_orderkey, l_linenumber, {_dcbor('l_quantity')} AS quantity, {_dcbor('l_extendedprice')} AS price FROM lineitem")
def encode_float_dcbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _hex(C.encode_float_dcbor(F.col("l_quantity"))).alias("quantity"), _hex(C.encode_float_dcbor(F.col("l_extendedprice"))).alias("price"))


_SPECIAL = ["NaN", "Infinity", "-Infinity", "0.0", "-0.0", "1.5", "65504.0", "65505.0", "65520.0", "5.960464477539063e-08", "6.103515625e-05", "2.5e-08", "1.1", "1e300", "-4.0", "16777217.0", "65536.5", "3.4028234663852886e38", "1.401298464324817e-45", "5e-324", "9223372036854775808.0", "1.8446744073709552e19", "-9223372036854775808.0", "-9.223372036854778e18"]


@_query(f"SELECT t, {_float('x')} AS rfc8949, {_dcbor('x')} AS dcbor FROM (SELECT t, t::DOUBLE AS x FROM (SELECT unnest({_SPECIAL}) AS t))")
def encode_float_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.expr("try_cast(t AS DOUBLE)")
    rows = spark.createDataFrame([(t,) for t in _SPECIAL], "t string").withColumn("x", x)
    return rows.select("t", _hex(C.encode_float(F.col("x"))).alias("rfc8949"), _hex(C.encode_float_dcbor(F.col("x"))).alias("dcbor"))


@_query(f"SELECT r_regionkey, 'a2' || {_key('r_name')} || {_text('r_name')} || {_key('r_regionkey')} || {_int('r_regionkey')} AS item FROM region")
def encode_struct_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "region")
    return rows.select("r_regionkey", _hex(typed.encode_struct(rows)).alias("item"))


@_query(
    f"SELECT s_suppkey, 'a4' || {_key('s_name')} || {_text('s_name')} || {_key('s_acctbal')} || {_float('s_acctbal')} || {_key('s_suppkey')} || {_int('s_suppkey')} || {_key('s_nationkey')} || {_int('s_nationkey')} AS item FROM supplier"
)
def encode_struct_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", _hex(typed.encode_struct(rows)).alias("item"))


@_query(
    f"SELECT o_orderkey, {_int('epoch_us(o_orderdate)')} AS item FROM orders"
)
def encode_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", _hex(typed.encode_column(F.col("o_orderdate"), rows.schema["o_orderdate"].dataType)).alias("item"))


@_query(f"SELECT vec_id, {_head(4, 'len(embedding)')} || list_aggregate(list_transform(embedding, lambda x: {_float('x::DOUBLE')}), 'string_agg', '') AS item FROM embeddings")
def encode_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", _hex(typed.encode_column(F.col("embedding"), rows.schema["embedding"].dataType)).alias("item"))


def _pairs(spark: SparkSession, sf_dir: str, key: Column, value: Column) -> DataFrame:
    """Entries of a map for each order, in order of line number."""
    e = F.struct("l_linenumber", C.encode_int(key).alias("k"), value.alias("v"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", e.alias("e")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("e")).alias("e"))


_BY_KEY = f"SELECT l_orderkey, l_linenumber, {_int('l_partkey')} AS k, {_float('l_quantity')} AS v FROM lineitem"
_FEW = f"SELECT l_orderkey, l_linenumber, {_int('l_partkey % 3')} AS k, {_int('l_linenumber')} AS v FROM lineitem"


@_query(f"SELECT l_orderkey, {_head(5, 'count(*)')} || string_agg(k || v, '' ORDER BY k, l_linenumber, v) AS item FROM ({_BY_KEY}) GROUP BY l_orderkey")
def encode_dynamic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir, F.col("l_partkey"), C.encode_float(F.col("l_quantity")))
    return rows.select("l_orderkey", _hex(C.encode_entries(F.col("e"))).alias("item"))


@_query(f"SELECT l_orderkey, {_head(5, 'count(*)')} || string_agg(k || v, '' ORDER BY k) AS item FROM (SELECT * FROM ({_FEW}) QUALIFY row_number() OVER (PARTITION BY l_orderkey, k ORDER BY l_linenumber DESC, v DESC) = 1) GROUP BY l_orderkey")
def map_collision_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir, F.col("l_partkey") % 3, C.encode_int(F.col("l_linenumber")))
    return rows.select("l_orderkey", _hex(C.encode_entries(F.col("e"), "dcbor")).alias("item"))


@_query(f"SELECT l_orderkey, {_head(5, 'count(*)')} || string_agg(k || v, '' ORDER BY k, l_linenumber, v) AS item FROM ({_FEW}) GROUP BY l_orderkey")
def map_duplicates_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir, F.col("l_partkey") % 3, C.encode_int(F.col("l_linenumber")))
    return rows.select("l_orderkey", _hex(C.encode_entries(F.col("e"))).alias("item"))


_POWERS = [k for k in range(65, 120, 6)]


@_query(
    f"SELECT k::BIGINT AS k, 'c2' || {_head(2, 'len(h) // 2')} || h AS positive, 'c3' || {_head(2, 'len(g) // 2')} || g AS negative FROM (SELECT k, lpad(h, ((len(h) + 1) // 2 * 2)::INT, '0') AS h, lpad(g, ((len(g) + 1) // 2 * 2)::INT, '0') AS g FROM (SELECT k, lower(to_hex(1::HUGEINT << k)) AS h, lower(to_hex((1::HUGEINT << k) - 1)) AS g FROM (SELECT unnest({_POWERS}) AS k)))"
)
def bignum_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, str(1 << k)) for k in _POWERS], "k long, d string")
    return rows.select("k", _hex(dynamic.encode_bignum(F.lit("positive"), F.col("d"))).alias("positive"), _hex(dynamic.encode_bignum(F.lit("negative"), F.col("d"))).alias("negative"))


@_query(f"SELECT o_orderkey, {_head(6, 'o_orderkey')} || {_int('o_custkey')} AS item FROM orders")
def tag_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", _hex(C.encode_tag(F.col("o_orderkey"), C.encode_int(F.col("o_custkey")))).alias("item"))


@_query(f"SELECT width, count(*)::BIGINT AS n FROM (SELECT (len({_float('x')}) - 2)::BIGINT // 2 AS width FROM (SELECT l_extendedprice AS x FROM lineitem UNION ALL SELECT l_discount FROM lineitem UNION ALL SELECT l_quantity FROM lineitem)) GROUP BY width")
def float_width_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_extendedprice", "l_discount", "l_quantity")).alias("x"))
    return rows.select(C.float_width(F.col("x")).alias("width")).groupBy("width").agg(F.count("*").alias("n"))


@_query(f"SELECT l_orderkey, l_linenumber, a AS first_hex, b AS second_hex FROM (SELECT l_orderkey, l_linenumber, {_float('l_discount')} AS a, {_dcbor('l_discount')} AS b FROM lineitem) WHERE a <> b")
def profile_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return canonical.divergence(rows, C.encode_float(F.col("l_discount")), C.encode_float_dcbor(F.col("l_discount"))).drop("l_discount")


_SIZED = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_mktsegment"), "part": ("p_partkey", "p_name", "p_brand")}


def _sized_sql(table: str, names: tuple[str, ...]) -> str:
    parts = " + ".join(f"len({_key(n)}) + len({_int(n) if n.endswith('key') else _text(n)})" for n in names)
    return f"SELECT '{table}' AS tab, count(*)::BIGINT AS n, (sum(2 + {parts}) // 2)::BIGINT AS octets FROM {table}"


@_query(" UNION ALL ".join(_sized_sql(t, n) for t, n in _SIZED.items()))
def canonical_size_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, fields in _SIZED.items():
        rows = _table(spark, sf_dir, name)
        one = rows.select(F.octet_length(typed.encode_struct(rows, list(fields))).cast("long").alias("o")).agg(F.lit(name).alias("tab"), F.count("*").alias("n"), F.sum("o").alias("octets")).select("tab", "n", "octets")
        out = one if out is None else out.unionByName(one)
    return out


def _order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return rows.select("o_orderkey", typed.encode_struct(rows).alias("item"))


_ORDER = f"'a4' || {_key('o_custkey')} || {_int('o_custkey')} || {_key('o_orderkey')} || {_int('o_orderkey')} || {_key('o_totalprice')} || {_float('o_totalprice')} || {_key('o_orderpriority')} || {_text('o_orderpriority')}"


@_query(f"SELECT o_orderkey, 'ACCEPT ' || {_ORDER} AS line FROM orders")
def decode_accept_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = _order_items(spark, sf_dir).select("o_orderkey", dynamic.decode_strict(F.col("item"), "rfc8949").alias("d"))
    return decoded.select("o_orderkey", dynamic.result_line(F.col("d")).alias("line"))


#: An edit of a canonical item, and what a strict decoder says to it under each profile.
_REJECTS = {
    "NON_SHORTEST_INT": ("REJECT", "REJECT"), "UNSORTED_MAP_KEYS": ("REJECT", "REJECT"), "DUPLICATE_KEY": ("REJECT", "REJECT"),
    "INDEFINITE_LENGTH": ("REJECT", "REJECT"), "NON_SHORTEST_FLOAT": ("REJECT", "REJECT"), "NAN_PAYLOAD_VARIANT": ("REJECT", "REJECT"),
    "TRAILING_BYTES": ("REJECT", "REJECT"), "MULTIPLE_TOP_LEVEL_ITEMS": ("REJECT", "REJECT"), "UNKNOWN_TAG": ("REJECT", "REJECT"),
    "NON_CANONICAL_BIGNUM": ("REJECT", "REJECT"), "NON_NFC_STRING": ("ACCEPT", "REJECT"), "UNREDUCED_NUMERIC": ("ACCEPT", "REJECT"),
}


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, edit and item: one edited item for each order and reason."""
    key = F.col("o_orderkey")
    raw = lambda x: F.unhex(F.lit(x))
    number, text = C.encode_int(key), C.encode_text(F.col("o_orderpriority"))
    long_int = F.concat(raw("1B"), F.unhex(F.lpad(F.hex(F.col("o_orderkey")), 16, "0")))
    wide = lambda x: F.concat(raw("FB"), F.unhex(F.lpad(F.hex(C.double_bits(x)), 16, "0")))
    edits = {
        "NON_SHORTEST_INT": long_int,
        "UNSORTED_MAP_KEYS": F.concat(raw("A26162"), number, raw("6161"), text),
        "DUPLICATE_KEY": F.concat(raw("A26161"), number, raw("6161"), text),
        "INDEFINITE_LENGTH": F.concat(raw("9F"), number, text, raw("FF")),
        "NON_SHORTEST_FLOAT": wide((key % 100).cast("double") + 0.5),
        "NAN_PAYLOAD_VARIANT": F.concat(raw("82"), number, raw("FB7FF8000000000000")),
        "TRAILING_BYTES": F.concat(text, raw("18")),
        "MULTIPLE_TOP_LEVEL_ITEMS": F.concat(text, raw("00")),
        "UNKNOWN_TAG": F.concat(raw("C1"), number),
        "NON_CANONICAL_BIGNUM": F.concat(raw("C248"), F.unhex(F.lpad(F.hex(key), 16, "0"))),
        "NON_NFC_STRING": C.encode_text(F.concat(F.col("o_orderpriority"), F.lit("é"))),
        "UNREDUCED_NUMERIC": C.encode_float((key % 1000).cast("double")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("edit"), v.alias("item")) for k, v in edits.items()])).alias("e")
    return _table(spark, sf_dir, "orders").select("o_orderkey", rows).select("o_orderkey", "e.edit", "e.item")


_NAMES = ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in _REJECTS.items())


@_query(
    f"SELECT edit, CASE WHEN a = 'REJECT' THEN edit ELSE a END AS rfc8949, CASE WHEN b = 'REJECT' THEN edit ELSE b END AS dcbor, (SELECT count(*) FROM orders)::BIGINT AS n FROM (VALUES {_NAMES}) AS t(edit, a, b)"
)
def reject_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _edited(spark, sf_dir).select("edit", dynamic.decode_both(F.col("item")).alias("d"))
    said = lambda p: F.coalesce(F.col("d")[p]["reason"], F.col("d")[p]["verdict"]).alias(p)
    return judged.groupBy("edit", said("rfc8949"), said("dcbor")).agg(F.count("*").alias("n"))


_TAILS = {"00": "MULTIPLE_TOP_LEVEL_ITEMS", "0000": "TRAILING_BYTES", "18": "TRAILING_BYTES", "1817": "TRAILING_BYTES", "8101": "MULTIPLE_TOP_LEVEL_ITEMS", "": "ACCEPT", "ff": "TRAILING_BYTES"}


@_query(f"SELECT tail, reason, (SELECT count(*) FROM nation)::BIGINT AS n FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _TAILS.items())}) AS t(tail, reason)")
def trailing_vs_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation")
    tails = rows.select(typed.encode_struct(rows).alias("item"), F.explode(F.array(*map(F.lit, _TAILS))).alias("tail"))
    judged = tails.select("tail", dynamic.decode_strict(F.concat("item", F.unhex("tail")), "rfc8949").alias("d"))
    return judged.groupBy("tail", F.coalesce("d.reason", "d.verdict").alias("reason")).agg(F.count("*").alias("n"))


@_query("SELECT cut::BIGINT AS cut, 'ERROR' AS verdict, (SELECT count(*) FROM customer)::BIGINT AS n FROM (SELECT unnest([1, 2, 3, 5]) AS cut)")
def malformed_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer")
    cuts = rows.select(typed.encode_struct(rows, ["c_custkey", "c_name"]).alias("item"), F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 5)])).alias("cut"))
    short = F.expr("substring(item, 1, octet_length(item) - cast(cut AS int))")
    return cuts.select("cut", dynamic.decode_strict(short, "rfc8949")["verdict"].alias("verdict")).groupBy("cut", "verdict").agg(F.count("*").alias("n"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results to be compared: names that a wrong implementation ("lossy") cuts, or leaves out."""
    rows = _table(spark, sf_dir, "customer").select(F.format_string("c-%07d", "c_custkey").alias("id"), F.col("c_mktsegment").alias("rule"), _hex(C.encode_text(F.col("c_name"))).alias("expected"), F.col("c_custkey").alias("k"))
    good = rows.select("id", F.lit("typed").alias("adapter"), F.col("expected").alias("actual"))
    lossy = rows.where("k % 7 <> 0").select("id", F.lit("lossy").alias("adapter"), F.when(F.col("k") % 5 == 0, F.lit("00")).otherwise(F.col("expected")).alias("actual"))
    expected = rows.crossJoin(F.broadcast(spark.createDataFrame([("typed",), ("lossy",)], "adapter string"))).withColumn("id", F.concat_ws("/", "adapter", "id"))
    actual = good.unionByName(lossy).withColumn("id", F.concat_ws("/", "adapter", "id")).select("id", "actual")
    return conformance.compare(expected, actual).withColumns({"profile": F.lit("rfc8949"), "mode": F.lit("encode")})


_RESULTS = "SELECT adapter, 'rfc8949' AS profile, 'encode' AS mode, c_mktsegment AS rule, adapter || '/' || printf('c-%07d', c_custkey) AS id, adapter = 'typed' OR (c_custkey % 7 <> 0 AND c_custkey % 5 <> 0) AS passed, adapter <> 'typed' AND c_custkey % 7 = 0 AS missing FROM customer, (SELECT unnest(['typed', 'lossy']) AS adapter)"
_REPORT = f"SELECT adapter, profile, mode, rule, count(*)::BIGINT AS total, count(*) FILTER (WHERE passed)::BIGINT AS passed, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE NOT passed), '') AS failed_ids FROM ({_RESULTS}) GROUP BY ALL"


@_query(_REPORT)
def conformance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.report(_results(spark, sf_dir)).withColumn("failed_ids", F.array_join("failed_ids", ","))


@_query(f"SELECT adapter, profile, mode, sum(total)::BIGINT AS total, sum(passed)::BIGINT AS passed, printf('%.0f', 100.0 * sum(passed) / sum(total)) AS pass_rate FROM ({_REPORT}) GROUP BY ROLLUP (adapter, profile, mode)")
def conformance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.overall(conformance.report(_results(spark, sf_dir)))


@_query(f"SELECT rule, max(passed || '/' || total) FILTER (WHERE adapter = 'typed') AS typed, max(passed || '/' || total) FILTER (WHERE adapter = 'lossy') AS lossy, 'n/a' AS absent FROM ({_REPORT}) GROUP BY rule")
def conformance_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.pivot(conformance.report(_results(spark, sf_dir)), "adapter", ["typed", "lossy", "absent"])


@_query(f"SELECT adapter, missing, count(*)::BIGINT AS n, count(*) FILTER (WHERE passed)::BIGINT AS passed FROM ({_RESULTS}) GROUP BY ALL")
def positional_left_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    return rows.groupBy("adapter", (F.col("actual") == "").alias("missing")).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@_query("SELECT 'rfc8949' AS profile, (SELECT count(*) FROM lineitem)::BIGINT AS n, 0::BIGINT AS different UNION ALL SELECT 'dcbor', (SELECT count(*) FROM lineitem)::BIGINT, 0::BIGINT")
def differential_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed against the dynamic encoder on the same rows."""
    rows = _spread(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag"))
    as_json = F.format_string(
        '{"type":"map","entries":[[{"type":"text","value":"l_returnflag"},{"type":"text","value":"%s"}],[{"type":"text","value":"l_extendedprice"},{"type":"float","width":"auto","value":"%s"}],[{"type":"text","value":"l_orderkey"},{"type":"int","value":"%s"}]]}',
        "l_returnflag", F.col("l_extendedprice").cast("string"), F.col("l_orderkey").cast("string"),
    )
    same = [typed.encode_struct(rows, profile=p).eqNullSafe(dynamic.encode_json(as_json, p)).alias(p) for p in C.PROFILES]
    counts = rows.select(*same).agg(F.count("*").alias("n"), *[F.count_if(~F.col(p)).alias(p) for p in C.PROFILES])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), "n", F.col(p).alias("different")) for p in C.PROFILES])).alias("x")).select("x.*")


@_query(f"SELECT sha256(unhex({_text('text')})) AS hash, count(*)::BIGINT AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.dedup(_table(spark, sf_dir, "documents"), C.encode_text(F.col("text")), "doc_id")


@_query("SELECT c_custkey, o_orderkey, sha256(unhex(item)) AS hash FROM (SELECT c_custkey, " + _int("c_custkey") + " AS item FROM customer) JOIN orders ON o_custkey = c_custkey")
def canonical_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = _table(spark, sf_dir, "customer").select("c_custkey"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return canonical.join(customers, orders, C.encode_int(F.col("c_custkey")), C.encode_int(F.col("o_custkey"))).select("c_custkey", "o_orderkey", "hash")


@_query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority LIKE '5%', o_orderkey) = 1")
def prefer_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return corpus.prefer_first(rows, F.col("o_custkey"), F.col("o_orderpriority").startswith("5"), F.col("o_orderkey")).drop("o_orderpriority")


@_query("SELECT printf('fuzz-rfc8949-%05d', row_number() OVER (ORDER BY o_orderpriority LIKE '5%', o_orderkey) - 1) AS id, o_orderkey FROM orders ORDER BY o_orderpriority LIKE '5%', o_orderkey LIMIT 500")
def prioritized_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").startswith("5").alias("late"))
    order = (F.col("late"), F.col("o_orderkey"))
    return corpus.numbered(corpus.capped(rows, 500, *order), "fuzz-rfc8949", *order).select("id", "o_orderkey")


@_query(
    f"SELECT verdict, count(*)::BIGINT AS n FROM (SELECT CASE WHEN b = k THEN 'DUPLICATE_KEY' WHEN b > k THEN 'UNSORTED_MAP_KEYS' ELSE 'OK' END AS verdict FROM (SELECT k, lag(k) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, k) AS b FROM ({_FEW})) WHERE b IS NOT NULL) GROUP BY verdict"
)
def adjacent_key_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.struct("l_linenumber", C.encode_int(F.col("l_partkey") % 3).alias("k")).alias("pos"), C.encode_int(F.col("l_partkey") % 3).alias("k"))
    return canonical.key_order(entries).groupBy("verdict").agg(F.count("*").alias("n"))


@_query("SELECT major::BIGINT AS major, sum(n)::BIGINT AS n FROM (SELECT 5 AS major, count(*) AS n FROM nation UNION ALL SELECT 3, 4 * count(*) FROM nation UNION ALL SELECT 0, 2 * count(*) FROM nation) GROUP BY major")
def node_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation")
    nodes = rows.select(F.explode(dynamic.nodes(typed.encode_struct(rows))).alias("x"))
    return nodes.groupBy(F.col("x.major").cast("long").alias("major")).agg(F.count("*").alias("n"))


@_query("SELECT event_type, 'ACCEPT' AS verdict, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events encoded row by row and validated strictly, as a stream of them would be."""
    from .streaming.validate import validate

    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    judged = validate(rows.select("event_type", typed.encode_struct(rows).alias("item")), "item", "rfc8949")
    return judged.groupBy("event_type", "verdict").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN 'f5' ELSE 'f4' END AS flag, CASE o_orderstatus WHEN 'P' THEN 'f6' WHEN 'F' THEN 'f5' ELSE 'f4' END AS item FROM orders")
def encode_bool_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = C.encode_bool(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", _hex(flag).alias("flag"), _hex(F.coalesce(flag, C.null_item())).alias("item"))


def _forced(x: str) -> str:
    short, single = _float(x), f"CAST(CAST(({x})::FLOAT AS BIT) AS UINTEGER)"
    return f"""CASE WHEN len({short}) = 6 THEN {short} END AS f16, CASE WHEN ({x})::FLOAT::DOUBLE = {x} THEN 'fa' || lpad(lower(to_hex({single})), 8, '0') END AS f32,
      'fb' || lpad(lower(to_hex(CAST(CAST(({x})::DOUBLE AS BIT) AS UBIGINT))), 16, '0') AS f64"""


@_query(f"SELECT l_orderkey, l_linenumber, {_forced('l_extendedprice')} FROM lineitem")
def encode_forced_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[_hex(C.encode_float(x, w)).alias(w) for w in ("f16", "f32", "f64")])


#: Items, and what both profiles say to them: text that is and is not UTF-8, simple values, values of major type 7.
_JUDGED = {"62c3a9": "ACCEPT", "62c328": "ERROR", "61ff": "ERROR", "63e282": "ERROR", "63eda080": "ERROR", "62c080": "ERROR", "f4": "ACCEPT", "f5": "ACCEPT", "f6": "ACCEPT", "f7": "ERROR", "e0": "ERROR", "f8ff": "ERROR", "ff": "ERROR", "1c": "ERROR", "": "ERROR"}


@_query(f"SELECT item, verdict AS rfc8949, verdict AS dcbor FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _JUDGED.items())}) AS t(item, verdict)")
def text_and_simple_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k,) for k in _JUDGED], "item string")
    both = rows.select("item", dynamic.decode_both(F.unhex("item")).alias("d"))
    return both.select("item", *[F.col("d")[p]["verdict"].alias(p) for p in C.PROFILES])


_PAIR = '[{"type":"text","value":"%s"},{"type":"%s","value":"'


@_query("SELECT c_custkey, '{\"type\":\"map\",\"entries\":[" + _PAIR % ("c_name", "text") + "' || c_name || '\"}]," + _PAIR % ("c_custkey", "int") + "' || c_custkey || '\"}]]}' AS value FROM customer")
def to_logical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return rows.select("c_custkey", dynamic.to_logical_json(typed.encode_struct(rows)).alias("value"))


def _scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; where the session names none, a local one (tests)."""
    import tempfile
    import uuid

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="cborlake-")
    return f"{folder}/cborlake-{uuid.uuid4().hex}"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each customer: id, rule, rationale, logical_value and expected_hex."""
    key = F.format_string('{"type":"int","value":"%d"}', "c_custkey")
    return _table(spark, sf_dir, "customer").select(F.format_string("v-%07d", "c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 == 0, F.lit("fuzz-generated")).otherwise(F.lit("P1")).alias("rule"), F.lit("shortest").alias("rationale"), key.alias("logical_value"), _hex(C.encode_int(F.col("c_custkey"))).alias("expected_hex"))


_VECTORS = f"SELECT printf('v-%07d', c_custkey) AS id, CASE WHEN c_custkey % 9 = 0 THEN 'fuzz-generated' ELSE 'P1' END AS rule, '{{\"type\":\"int\",\"value\":\"' || c_custkey || '\"}}' AS logical_value, {_int('c_custkey')} AS expected_hex FROM customer"


@_query(_VECTORS)
def vectors_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    vectors.write_vectors(_vectors(spark, sf_dir), path)
    return vectors.read_vectors(spark, path).select("id", "rule", "logical_value", "expected_hex")


@_query(f"SELECT id, rule, expected_hex AS input_hex, 'ACCEPT ' || expected_hex AS expected_line, 'ACCEPT ' || expected_hex AS actual FROM ({_VECTORS}) WHERE rule <> 'fuzz-generated' UNION ALL SELECT 'r-' || id, 'TRAILING_BYTES', expected_hex || '18', 'REJECT TRAILING_BYTES', 'REJECT TRAILING_BYTES' FROM ({_VECTORS})")
def decode_vectors_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode vectors derived from encode vectors and rejects, run through a registered implementation."""
    own = _vectors(spark, sf_dir)
    rejects = own.select(F.concat(F.lit("r-"), "id").alias("id"), F.lit("TRAILING_BYTES").alias("rule"), F.concat("expected_hex", F.lit("18")).alias("input_hex"), F.lit("TRAILING_BYTES").alias("expected_reason"))
    rows = vectors.decode_vectors(own, rejects)
    return rows.join(registry.run_decode(rows, "dynamic", "rfc8949"), "id").select("id", "rule", "input_hex", "expected_line", "actual")


@_query(f"SELECT a.adapter, id, expected_hex AS actual FROM ({_VECTORS}), (SELECT unnest(['dynamic', 'dynamic-strict']) AS adapter) AS a")
def vectors_by_implementation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with each registered implementation, and what that one gives."""
    pairs = conformance.cross(_vectors(spark, sf_dir), registry.table(spark), "rfc8949")
    out = None
    for name in ("dynamic", "dynamic-strict"):
        some = pairs.where(F.col("adapter") == name)
        one = registry.run_encode(some, name, "rfc8949").select(F.lit(name).alias("adapter"), "id", "actual")
        out = one if out is None else out.unionByName(one)
    return out


@_query(f"SELECT expected_hex AS input_hex, expected_hex AS item FROM ({_VECTORS})")
def hex_lines_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written with blank ones among them, and read without these."""
    path = _scratch(spark)
    own = _vectors(spark, sf_dir).select("expected_hex")
    vectors.write_lines(own.unionByName(own.select(F.lit("").alias("expected_hex"))), "expected_hex", path)
    return vectors.read_hex_lines(spark, path).select("input_hex", _hex(F.col("item")).alias("item"))


@_query(f"SELECT logical_value, expected_hex AS item FROM ({_VECTORS})")
def value_lines_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    vectors.write_lines(_vectors(spark, sf_dir), "logical_value", path)
    return vectors.read_value_lines(spark, path).select("logical_value", _hex(dynamic.encode_json(F.col("logical_value"), "rfc8949")).alias("item"))


@_query(f"SELECT id, adapter, rule FROM ({_RESULTS}) WHERE NOT passed ORDER BY id LIMIT 20")
def first_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.mismatches(_results(spark, sf_dir)).select("id", "adapter", "rule")


@_query(f"SELECT adapter, bool_and(passed) AS passed FROM ({_RESULTS}) GROUP BY adapter")
def gate_by_implementation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    return spark.createDataFrame([(a, conformance.all_passed(rows.where(F.col("adapter") == a))) for a in ("typed", "lossy")], "adapter string, passed boolean")


@_query(f"SELECT adapter, rule, total, CASE adapter WHEN 'typed' THEN total ELSE passed END AS passed FROM ({_REPORT})")
def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An early report in which nothing passed gives way to the later one."""
    late = conformance.report(_results(spark, sf_dir))
    early = conformance.report(_results(spark, sf_dir).where("adapter = 'typed'").withColumn("passed", F.lit(False)))
    return conformance.merge(early, late).select("adapter", "rule", "total", "passed")


@_query(f"SELECT 'candidates' AS stage, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'agreed', count(*) FILTER (WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0) FROM customer UNION ALL SELECT 'mismatched', count(*) FILTER (WHERE c_custkey % 4 <> 0 AND c_custkey % 5 = 0 AND c_custkey % 7 <> 0) FROM customer")
def oracle_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the oracle refuses (every fourth) or an implementation leaves out (every seventh) is neither; every fifth differs."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _hex(C.encode_int(F.col("c_custkey"))).alias("hex"))
    oracle = rows.select("id", F.when(F.col("id") % 4 != 0, F.col("hex")).alias("oracle_hex"))
    candidates = rows.select("id", F.when(F.col("id") % 7 == 0, F.lit("")).when(F.col("id") % 5 == 0, F.lit("00ff")).otherwise(F.col("hex")).alias("actual_hex"))
    agreed, mismatched = corpus.agreed(candidates, oracle)
    return corpus.stage_counts(candidates=candidates, agreed=agreed, mismatched=mismatched)


@_query("SELECT 'ACCEPT' AS verdict, 2000::BIGINT AS n, true AS follows_grammar, true AS same")
def generated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random values: they follow the grammar, are accepted once encoded, and come back as the same bytes."""
    rows = generate.values(spark, 2000, known_tags=True)
    item = rows.select(dynamic.is_valid_json(F.col("logical_value")).alias("follows_grammar"), dynamic.encode_json(F.col("logical_value"), "dcbor").alias("item"))
    judged = item.select("follows_grammar", "item", dynamic.decode_strict(F.col("item"), "dcbor")["verdict"].alias("verdict"), dynamic.encode_json(dynamic.to_logical_json(F.col("item")), "dcbor").alias("back"))
    return judged.groupBy("verdict").agg(F.count("*").alias("n"), F.bool_and("follows_grammar").alias("follows_grammar"), F.bool_and(F.col("item") == F.col("back")).alias("same"))
