"""Views of the given tables that the registered queries stand on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.features import DIMS as FEATURES
from tessera.functions.features import opened, vector_blocks, with_vector
from tessera.functions.vectors import quantize_array
from tessera.operators import index_build
from tessera.operators.cells import SAMPLE
from tessera.sources.index import read_index, write_index
from tessera.sources.payloads import to_payload
from tessera.sources.shared import Scratch

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
DIMS, CLUSTERS, PROBES, EVERY, ROUNDS = 64, 16, 4, 10, 2
#: The index over the features of all transactions: clusters, probes, rounds of training, and which orders are queries.
TX_CLUSTERS, TX_PROBES, TX_ROUNDS, TX_EVERY = 64, 12, 1, 50
#: Line items of a task that joins them.
PART_ROWS = 1_000_000
#: Most parts or suppliers (three columns, some 60 bytes each) that go to every executor.
MOST_SENT = 2_000_000
MCCS = ("5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "0000")


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction for each line item."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # dealt by the key of the join that follows, so it costs nothing where that shuffles, and a few large row groups don't hold up the rest where it doesn't;
    # in parts of a bounded size, so that a part's orders are hashed in memory and its lines needn't be sorted
    lines = t("lineitem").select(*KEYS, "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    parts = lines.count() // PART_ROWS  # from the footers
    lines = lines.repartition(parts, "l_orderkey") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else lines.repartition("l_orderkey")
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))  # before the lines, which are more
    few = lambda df: F.broadcast(df) if df.count() <= MOST_SENT else df  # noqa: E731  all lines needn't be shuffled and sorted again for them
    line = lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).join(few(t("part")), F.col("l_partkey") == F.col("p_partkey")).join(few(t("supplier")), F.col("l_suppkey") == F.col("s_suppkey"))
    merchant = lambda n: F.concat(F.lit("MERC-"), n.cast("string"))
    seconds = ((F.col("l_orderkey") * 37 + F.col("l_partkey")) % 86400).cast("int")
    first = F.col("l_linenumber") == 1
    return line.select(
        *KEYS, F.col("p_retailprice").alias("amount"), F.col("l_linenumber").alias("installments"), F.timestamp_add("SECOND", seconds, F.col("l_shipdate").cast("timestamp")).alias("requested_at"), F.col("c_acctbal").alias("avg_amount"),
        F.col("l_quantity").alias("tx_count_24h"), F.array(merchant(F.col("o_custkey") % 20), merchant((F.col("o_custkey") + 7) % 20)).alias("known_merchants"), merchant(F.col("l_suppkey") % 20).alias("merchant_id"),
        F.element_at(F.array(*map(F.lit, MCCS)), (F.col("p_size") % 11 + 1).cast("int")).alias("mcc"), F.col("s_acctbal").alias("merchant_avg"), (F.col("l_returnflag") == "R").alias("is_online"), (F.col("l_linestatus") == "F").alias("card_present"),
        (F.col("l_partkey") % 1500).alias("km_from_home"), F.when(~first, F.col("o_orderdate").cast("timestamp")).alias("last_at"), F.when(~first, F.col("l_suppkey") % 1200).alias("last_km"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, v, label) of embeddings; the label is 1 where theirs is under 5."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("ref_id"), quantize_array(F.col("embedding")).alias("v"), (F.col("label") < 5).cast("int").alias("label"))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, v): the stated query set of the searches, every tenth vector."""
    return refs(spark, sf_dir).where(F.col("ref_id") % EVERY == 0).select(F.col("ref_id").alias("qid"), "v")


def first_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vectors as centroids, so that all that follows has an SQL form."""
    return refs(spark, sf_dir).where(F.col("ref_id") < CLUSTERS).select(F.col("ref_id").cast("int").alias("cluster_id"), F.col("v").alias("centroid"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids trained from the first vectors."""
    return index_build.lloyd(refs(spark, sf_dir), first_centroids(spark, sf_dir), DIMS, ROUNDS)


def _kept(spark: SparkSession, name: str, sf_dir: str, make: Callable[[str], None]) -> str:
    """The folder of what is made once in a session."""
    kept = Scratch.of(spark).kept
    if (name, sf_dir) not in kept:
        path = Scratch.of(spark).folder(name)
        make(path)
        kept[name, sf_dir] = path
    return kept[name, sf_dir]


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cluster table, assigned vectors)."""
    mine = centroids(spark, sf_dir)
    assigned = index_build.assign(refs(spark, sf_dir), mine)
    return index_build.cluster_table(assigned, mine, DIMS), assigned


def tx_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, v, label) of all transactions; the label is 1 where they are online."""
    return with_vector(_tx_labelled(spark, sf_dir), "ref_id", "label").select("ref_id", "v", "label")


def _tx_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx(spark, sf_dir).withColumns({"ref_id": F.expr(TX_ID), "label": F.coalesce("is_online", F.lit(False)).cast("int")})


def tx_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """SRC-5, SRC-6: the index over tx_refs(), written once in a session and read back."""

    def make(path: str) -> None:
        vector_blocks(_tx_labelled(spark, sf_dir), "ref_id", "label").write.parquet(f"{path}/refs")
        blocks = spark.read.parquet(f"{path}/refs")
        n, first, some = index_build.block_sample(blocks, opened, TX_CLUSTERS, SAMPLE)
        start = spark.createDataFrame([(i, v) for i, v in enumerate(first)], "cluster_id int, centroid array<smallint>")
        trained = index_build.lloyd(blocks, start, FEATURES, TX_ROUNDS, opened)
        some = index_build.assign(spark.createDataFrame(some), trained).toArrow()  # bounded
        assigning = index_build.assigning(trained)
        write_index(f"{path}/index", lambda vectors: index_build.cluster_table(vectors, trained, FEATURES), blocks, FEATURES, sample=(n, some), opened=lambda batches: assigning(opened(batches)))

    return read_index(spark, _kept(spark, "tx-index", sf_dir, make) + "/index", FEATURES)


def tx_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conn_id, seq, body): payloads of all lines of every 50th order, as they would come from a source."""

    def make(path: str) -> None:
        rows = tx(spark, sf_dir).where(f"l_orderkey % {TX_EVERY} = 0")
        to_payload(rows, *KEYS).select(F.col("l_orderkey").alias("conn_id"), F.expr(TX_ID).alias("seq"), "body").write.parquet(path)

    return spark.read.parquet(_kept(spark, "tx-requests", sf_dir, make))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, body, expected_approved, expected_count) of the requests: invented expectations from the ids; some bodies can't be parsed."""
    count = (F.floor(F.col("conn_id") / TX_EVERY) % 6).cast("int")
    body = F.when(F.col("conn_id") % BROKEN == 0, F.substring("body", 1, 40)).otherwise(F.col("body"))
    return tx_requests(spark, sf_dir).select(F.col("seq").alias("qid"), body.alias("body"), (count <= 2).alias("expected_approved"), count.alias("expected_count"))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conn_id, raw): invented buffers with pipelined requests of customers, bodies outside ASCII, and every kind of end."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("conn_id"), F.expr(RAW).alias("raw"))


#: A transaction's number, in both engines.
TX_ID = "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey"
#: Orders whose payloads are broken off.
BROKEN = 350

# Buffers, as SQL of both engines: a request whose body holds characters of two and three bytes, a readiness check, a request with a length in
# small letters and spaces, and an end by the customer's number: half a header, a body that lacks its last byte, a bad method with more behind, or nothing.
_LINE = "chr(13) || chr(10)"
BODY_1, BODY_2 = "'{\"name\":\"Žofie ' || c_name || '\"}'", "repeat('東é', CAST(c_custkey % 5 AS INT))"


def _post(body: str, size: str, header: str = "Content-Length: ") -> str:
    return f"'POST /score HTTP/1.1' || {_LINE} || 'Host: h' || {_LINE} || '{header}' || CAST({size} AS STRING) || {_LINE} || {_LINE} || {body}"


_GET = f"'GET /live HTTP/1.1' || {_LINE} || {_LINE}"
_PUT = f"'PUT /x HTTP/1.1' || {_LINE} || 'Content-Length: 9' || {_LINE} || {_LINE}"
ENDS = (f"'POST /score HTTP/1.1' || {_LINE} || 'Content-Le'", _post("'aé'", "4"), f"{_PUT} || {_GET}", "''")


def raw_parts(size: str) -> tuple[str, str, str, str]:
    """The requests of a buffer and its end; `size` is the engine's function for bytes of a string."""
    end = f"CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN {ENDS[0]} WHEN 1 THEN {ENDS[1]} WHEN 2 THEN {ENDS[2]} ELSE {ENDS[3]} END"
    return _post(BODY_1, f"{size}({BODY_1})"), _GET, _post(BODY_2, f"{size}({BODY_2})", "content-LENGTH:   "), end


RAW = " || ".join(raw_parts("octet_length"))


#: DuckDB: the same views as common table expressions.
SQL_TX = """
tx AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(p_retailprice AS FLOAT) AS amount, CAST(l_linenumber AS FLOAT) AS installments,
  l_shipdate + to_seconds(CAST((l_orderkey * 37 + l_partkey) % 86400 AS INTEGER)) AS requested_at, CAST(c_acctbal AS FLOAT) AS avg_amount, CAST(l_quantity AS FLOAT) AS tx_count_24h,
  ['MERC-' || (o_custkey % 20), 'MERC-' || ((o_custkey + 7) % 20)] AS known_merchants, 'MERC-' || (l_suppkey % 20) AS merchant_id,
  (['5411', '5812', '5912', '5944', '7801', '7802', '7995', '4511', '5311', '5999', '0000'])[p_size % 11 + 1] AS mcc, CAST(s_acctbal AS FLOAT) AS merchant_avg,
  l_returnflag = 'R' AS is_online, l_linestatus = 'F' AS card_present, CAST(l_partkey % 1500 AS FLOAT) AS km_from_home,
  CASE WHEN l_linenumber <> 1 THEN o_orderdate END AS last_at, CASE WHEN l_linenumber <> 1 THEN CAST(l_suppkey % 1200 AS FLOAT) END AS last_km
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""


def _f(x: float) -> str:
    return f"CAST({x!r} AS FLOAT)"


def _clamp(x: str) -> str:
    return f"greatest({_f(0.0)}, least({_f(1.0)}, {x}))"


def _q(x: str) -> str:
    return f"CAST(round(greatest(-10000.0::DOUBLE, least(10000.0::DOUBLE, CAST({x} AS DOUBLE) * 10000))) AS INTEGER)"


_RISK = "CASE mcc WHEN '5411' THEN 0.15 WHEN '5812' THEN 0.30 WHEN '5912' THEN 0.20 WHEN '5944' THEN 0.45 WHEN '7801' THEN 0.80 WHEN '7802' THEN 0.75 WHEN '7995' THEN 0.85 WHEN '4511' THEN 0.35 WHEN '5311' THEN 0.25 WHEN '5999' THEN 0.50 ELSE 0.5 END"
_GUARDED = f"CASE WHEN avg_amount > 0 THEN avg_amount ELSE {_f(1.0)} END"
_MINUTES = f"CAST(CAST(epoch(requested_at) - epoch(last_at) AS BIGINT) AS FLOAT) / {_f(60.0)}"
SQL_VALUES = (
    _clamp(f"amount * {_f(1 / 10000)}"), _clamp(f"installments * {_f(1 / 12)}"), _clamp(f"CAST(amount / ({_GUARDED}) AS FLOAT) * {_f(1 / 10)}"), f"CAST(hour(requested_at) AS FLOAT) * {_f(1 / 23)}",
    f"CAST(isodow(requested_at) - 1 AS FLOAT) * {_f(1 / 6)}", f"CASE WHEN last_at IS NULL THEN {_f(-1.0)} ELSE {_clamp(f'CAST({_MINUTES} AS FLOAT) * {_f(1 / 1440)}')} END",
    f"CASE WHEN last_at IS NULL THEN {_f(-1.0)} ELSE {_clamp(f'last_km * {_f(1 / 1000)}')} END", _clamp(f"km_from_home * {_f(1 / 1000)}"), _clamp(f"tx_count_24h * {_f(1 / 20)}"), f"CASE WHEN is_online THEN {_f(1.0)} ELSE {_f(0.0)} END",
    f"CASE WHEN card_present THEN {_f(1.0)} ELSE {_f(0.0)} END", f"CASE WHEN list_contains(known_merchants, merchant_id) THEN {_f(0.0)} ELSE {_f(1.0)} END", f"CAST({_RISK} AS FLOAT)", _clamp(f"merchant_avg * {_f(1 / 10000)}"),
)
SQL_FEATURES = f"{SQL_TX},\nfeat AS (SELECT {', '.join(KEYS)}, {', '.join(f'{_q(v)} AS d{i}' for i, v in enumerate(SQL_VALUES))} FROM tx)"

def sql_l2(a: str, b: str, dims: int = DIMS) -> str:
    return "(" + " + ".join(f"CAST({a}[{i}] - {b}[{i}] AS BIGINT) * ({a}[{i}] - {b}[{i}])" for i in range(1, dims + 1)) + ")"


def _sql_lloyd(refs: str, start: str, rounds: int, dims: int) -> str:
    """CTEs cent0 (given as `start`), cent1, ...: means of the nearest refs, rounded; a cluster without refs keeps its centroid."""
    out = f"cent0 AS MATERIALIZED ({start})"
    for i in range(rounds):
        out += f""",
move{i} AS MATERIALIZED (SELECT cluster_id, [{", ".join(f"CAST(round(avg(v[{k}])) AS INTEGER)" for k in range(1, dims + 1))}] AS centroid FROM ({sql_nearest(refs, f"cent{i}", dims)}) GROUP BY cluster_id),
cent{i + 1} AS MATERIALIZED (SELECT c.cluster_id, coalesce(m.centroid, c.centroid) AS centroid FROM cent{i} AS c LEFT JOIN move{i} AS m USING (cluster_id))"""
    return out


def sql_nearest(refs: str, cent: str, dims: int) -> str:
    """refs with their nearest centroid and the distance to it."""
    return f"SELECT r.*, n.c.c AS cluster_id, n.c.d AS dist FROM {refs} AS r JOIN (SELECT ref_id, min({{'d': {sql_l2('v', 'centroid', dims)}, 'c': cluster_id}}) AS c FROM {refs}, {cent} GROUP BY ref_id) AS n USING (ref_id)"


def sql_search(dims: int, cent: str, probes: int, skip_self: bool) -> str:
    """CTEs from refs, qs and the centroids of `cent` to the fast pass: asg, cnts, box, probes, first, fvote."""
    other = "WHERE qid <> a.ref_id" if skip_self else ""
    gap = lambda i: f"CAST(greatest(0, lo[{i}] - q.v[{i}], q.v[{i}] - hi[{i}]) AS BIGINT)"
    low, high = (", ".join(f"{f}(v[{i}])" for i in range(1, dims + 1)) for f in ("min", "max"))
    return f"""cent AS (SELECT * FROM {cent}),
asg AS MATERIALIZED ({sql_nearest("refs", "cent", dims)}),
cnts AS (SELECT cluster_id, CAST(count(ref_id) AS BIGINT) AS cnt FROM cent LEFT JOIN asg USING (cluster_id) GROUP BY cluster_id),
box AS MATERIALIZED (SELECT cluster_id, [{low}] AS lo, [{high}] AS hi FROM asg GROUP BY cluster_id),
probes AS MATERIALIZED (SELECT * FROM (SELECT qid, q.v AS qv, cluster_id, {sql_l2("q.v", "centroid", dims)} AS d FROM qs AS q, cent) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, cluster_id) <= {probes}),
nearest AS MATERIALIZED (SELECT qid, min({{'dist': {sql_l2("qv", "a.v", dims)}, 'ref_id': a.ref_id, 'label': a.label}}, 5) AS t FROM probes JOIN asg AS a USING (cluster_id) {other} GROUP BY qid),
first AS (SELECT qid, t.dist AS dist, t.ref_id AS ref_id, t.label AS label FROM (SELECT qid, unnest(t) AS t FROM nearest)),
fvote AS MATERIALIZED (SELECT qid, coalesce(CAST(sum(label) AS INTEGER), 0) AS fraud_count, CAST(count(ref_id) AS INTEGER) AS found, CASE WHEN count(ref_id) = 5 THEN max(dist) END AS worst FROM qs LEFT JOIN first USING (qid) GROUP BY qid),
bound AS (SELECT qid, cluster_id, {" + ".join(f"{gap(i)} * {gap(i)}" for i in range(1, dims + 1))} AS bound FROM qs AS q, box)"""


SQL_REFS = f"refs AS (SELECT vec_id AS ref_id, list_transform(embedding, lambda x: {_q('x')}) AS v, CAST(label < 5 AS INTEGER) AS label FROM embeddings),\nqs AS (SELECT ref_id AS qid, v FROM refs WHERE ref_id % {EVERY} = 0)"
SQL_PAIRS = f"{SQL_REFS},\npairs AS (SELECT qid, ref_id, label, {sql_l2('q.v', 'r.v')} AS dist FROM qs AS q JOIN refs AS r ON q.qid <> r.ref_id)"
SQL_TOP = f"{SQL_PAIRS},\ntop AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) AS rank FROM pairs QUALIFY rank <= 5)"
SQL_VOTE = "vote AS (SELECT qid, CAST(sum(label) AS INTEGER) AS fraud_count, CAST(count(*) AS INTEGER) AS found, CASE WHEN count(*) = 5 THEN max(dist) END AS worst FROM top GROUP BY qid)"
SQL_CENT = "SELECT CAST(ref_id AS INTEGER) AS cluster_id, v AS centroid FROM refs WHERE ref_id < " + str(CLUSTERS)
SQL_TRAIN = f"{SQL_REFS},\n{_sql_lloyd('refs', SQL_CENT, ROUNDS, DIMS)}"
SQL_INDEX = f"{SQL_TRAIN},\n{sql_search(DIMS, f'cent{ROUNDS}', PROBES, True)},\nlong AS (SELECT cluster_id, i, min(v[i]) AS lo, max(v[i]) AS hi FROM asg, range(1, {DIMS + 1}) AS t(i) GROUP BY cluster_id, i)"

#: The same over the features of all transactions; queries whose payloads are broken have no vector and are not in qs.
SQL_TX_REFS = f"""{SQL_FEATURES},
refs AS MATERIALIZED (SELECT {TX_ID} AS ref_id, l_orderkey, [{", ".join(f"d{i}" for i in range(FEATURES))}] AS v, CAST(d9 = 10000 AS INTEGER) AS label FROM feat),
want AS MATERIALIZED (SELECT ref_id AS qid, v, l_orderkey % {BROKEN} <> 0 AS parsed, CAST((l_orderkey // {TX_EVERY}) % 6 AS INTEGER) AS expected_count, (l_orderkey // {TX_EVERY}) % 6 <= 2 AS expected_approved FROM refs WHERE l_orderkey % {TX_EVERY} = 0)"""
SQL_TX_CENT = f"SELECT CAST(row_number() OVER (ORDER BY md5(ref_id || '-42'), ref_id) - 1 AS INTEGER) AS cluster_id, v AS centroid FROM refs QUALIFY cluster_id < {TX_CLUSTERS}"


def sql_tx(broken: bool, probes: int = TX_PROBES) -> str:
    """CTEs of the search over transactions, by all requests or by those that can be parsed."""
    some = "WHERE parsed" if broken else ""
    return f"{SQL_TX_REFS},\nqs AS MATERIALIZED (SELECT qid, v FROM want {some}),\n{_sql_lloyd('refs', SQL_TX_CENT, TX_ROUNDS, FEATURES)},\n{sql_search(FEATURES, f'cent{TX_ROUNDS}', probes, False)}"


def sql_repair(low: int, high: int, thresholds: tuple[int, ...] = (4294967295,) * 6, dims: int = FEATURES, skip_self: bool = False) -> str:
    """CTEs cand, more, top and vote after sql_search()."""
    other = "WHERE c.qid <> a.ref_id" if skip_self else ""
    return f"""cand AS MATERIALIZED (SELECT b.qid, b.cluster_id, b.bound FROM bound AS b JOIN fvote USING (qid) WHERE (fraud_count BETWEEN {low} AND {high} OR worst IS NULL OR worst >= ({list(thresholds)})[fraud_count + 1]) AND (worst IS NULL OR bound < worst)
  AND NOT EXISTS (SELECT 1 FROM probes AS p WHERE p.qid = b.qid AND p.cluster_id = b.cluster_id)),
more AS (SELECT c.qid, min({{'dist': {sql_l2("q.v", "a.v", dims)}, 'ref_id': a.ref_id, 'label': a.label}}, 5) AS t FROM cand AS c JOIN qs AS q ON q.qid = c.qid JOIN asg AS a ON a.cluster_id = c.cluster_id {other} GROUP BY c.qid),
top AS (SELECT * FROM (SELECT * FROM first UNION ALL SELECT qid, t.dist, t.ref_id, t.label FROM (SELECT qid, unnest(t) AS t FROM more)) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, ref_id) <= 5),
vote AS MATERIALIZED (SELECT qid, coalesce(CAST(sum(label) AS INTEGER), 0) AS fraud_count, CAST(count(ref_id) AS INTEGER) AS found, CASE WHEN count(ref_id) = 5 THEN max(dist) END AS worst FROM qs LEFT JOIN top USING (qid) GROUP BY qid)"""


def sql_replayed(votes: str) -> str:
    """CTE rep: the cases with the votes of `votes`; what can't be parsed counts 0."""
    return f"rep AS (SELECT want.qid, parsed, expected_count, expected_approved, coalesce(fraud_count, 0) AS fraud_count, worst, coalesce(fraud_count, 0) <= 2 AS approved FROM want LEFT JOIN {votes} AS f USING (qid))"


#: Exact votes on all requests.
SQL_TX_EXACT = f"""{SQL_TX_REFS},
nn AS (SELECT qid, min({{'dist': {sql_l2("q.v", "r.v", FEATURES)}, 'ref_id': r.ref_id, 'label': r.label}}, 5) AS t FROM want AS q, refs AS r GROUP BY qid),
vote AS (SELECT qid, CAST(sum(t.label) AS INTEGER) AS fraud_count, CAST(count(*) AS INTEGER) AS found, CASE WHEN count(*) = 5 THEN max(t.dist) END AS worst FROM (SELECT qid, unnest(t) AS t FROM nn) GROUP BY qid)"""
