"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantle.functions import hashing, rings, tokens
from cantle.functions.codec import FRAME_DDL
from cantle.operators import relational as rel
from cantle.plans import adapters as ad
from cantle.session import scratch
from cantle.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def hex_sql(namespace: str, value: str) -> str:
    return f"substr(sha256('20260713:{namespace}:' || CAST({value} AS VARCHAR)), 1, 16)"


def fraction_sql(namespace: str, value: str) -> str:
    return f"(CAST(CAST(('0x' || {hex_sql(namespace, value)}) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0)"


DOCS = """docs AS (
  SELECT d.doc_id, d.n_chars, CASE WHEN l.quality = 1 THEN 'simple_rectangle' ELSE 'complex' END AS difficulty,
         CASE WHEN n_chars <= 1600 THEN '4' WHEN n_chars <= 3200 THEN '5-8' WHEN n_chars <= 6400 THEN '9-16' ELSE '17+' END AS bucket
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
LINES = """seqs AS (
  SELECT l_orderkey AS id, list(CAST(l_quantity AS INT) ORDER BY l_linenumber, l_partkey, l_shipdate, l_quantity) AS tokens
  FROM lineitem GROUP BY l_orderkey)"""
EVENTS = """seqs AS (
  SELECT user_id AS id, list(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END ORDER BY ts, event_id) AS tokens
  FROM events GROUP BY user_id)"""
PREDS = LINES + """, preds AS (
  SELECT id, tokens AS target, CASE id % 3 WHEN 0 THEN tokens WHEN 1 THEN tokens[1:len(tokens) - 1] ELSE list_append(tokens[1:len(tokens) - 1], 51) END AS pred FROM seqs)"""
TARGETS = """targets AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'x' WHEN o_orderkey % 89 = 0 THEN '-1' ELSE CAST(o_custkey AS VARCHAR) END AS key,
         CASE WHEN o_orderkey % 83 = 0 THEN 'other' ELSE CAST(o_custkey AS VARCHAR) END AS name FROM orders
), keyed AS (
  SELECT *, TRY_CAST(key AS BIGINT) AS fk FROM targets
), early AS (
  SELECT *, CASE WHEN fk IS NULL THEN 'invalid' WHEN fk < 0 OR fk >= (SELECT count(*) FROM customer) THEN 'out_of_range' END AS early FROM keyed
), audit AS (
  SELECT e.o_orderkey, e.fk, CASE WHEN early IS NOT NULL THEN early
    WHEN row_number() OVER (PARTITION BY early, e.fk ORDER BY o_orderkey) > 1 THEN 'duplicate'
    WHEN name <> coalesce(CAST(c.c_custkey AS VARCHAR), CAST(e.fk AS VARCHAR)) THEN 'mismatch' ELSE 'paired' END AS outcome
  FROM early e LEFT JOIN customer c ON c.c_custkey = e.fk)"""
STARS = """polar AS (
  SELECT vec_id AS id, i, 5.0 + 20.0 * abs(CAST(embedding[i + 1] AS DOUBLE)) AS r, i * (2 * pi() / 64) AS a
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)
), pts AS (SELECT id, i, r * cos(a) AS x, r * sin(a) AS y FROM polar
), edge AS (
  SELECT p.id, p.i, p.x, p.y, q.x AS x2, q.y AS y2, q.x - p.x AS dx, q.y - p.y AS dy, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS len
  FROM pts p JOIN pts q ON p.id = q.id AND q.i = (p.i + 1) % 64)"""


def _docs(spark, sf_dir):
    return ad.documents(spark, sf_dir)


def _long(c: str):
    return F.col(c).cast("long").alias(c)


# -- hashing, splits and samples -------------------------------------------------------------------
@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN {fraction_sql('split', 'doc_id')} < 0.8 THEN 'train' ELSE 'validation' END AS split, {fraction_sql('split', 'doc_id')} AS fraction FROM docs")
def split_assign(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", hashing.split_of(F.col("doc_id")).alias("split"), hashing.stable_fraction(F.col("doc_id"), "split").alias("fraction"))


@query(f"WITH {DOCS} SELECT doc_id, difficulty FROM docs WHERE difficulty <> 'simple_rectangle' OR {fraction_sql('rectangle', 'doc_id')} < 0.1")
def stratified_keep(spark, sf_dir):
    return _docs(spark, sf_dir).where(hashing.keeps_sample(F.col("doc_id"), F.col("difficulty"))).select("doc_id", "difficulty")


@query(f"WITH {DOCS} SELECT {hex_sql('bpe', 'doc_id')} AS hash16, doc_id FROM docs ORDER BY hash16, CAST(doc_id AS VARCHAR) LIMIT 100")
def hash_topk_bpe(spark, sf_dir):
    return rel.hash_sample(_docs(spark, sf_dir), "doc_id", 100, "bpe").select("hash16", "doc_id")


@query(f"WITH {DOCS} SELECT {hex_sql('diagnostic', 'doc_id')} AS hash16, doc_id FROM docs WHERE difficulty = 'complex' ORDER BY hash16, CAST(doc_id AS VARCHAR) LIMIT 512")
def hash_topk_complex(spark, sf_dir):
    return rel.hash_sample(_docs(spark, sf_dir).where("difficulty = 'complex'"), "doc_id", 512, "diagnostic").select("hash16", "doc_id")


@query(f"WITH {DOCS} SELECT doc_id, {hex_sql('shuffle1', 'doc_id')} AS k FROM docs")
def shuffle_order(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", hashing.shuffle_key(F.col("doc_id"), 1).alias("k")).orderBy("k", "doc_id")


# -- grouped statistics ----------------------------------------------------------------------------
@query(f"""WITH {DOCS}, g AS (
  SELECT 'overall' AS grp, n_chars FROM docs UNION ALL SELECT difficulty, n_chars FROM docs UNION ALL SELECT 'vertices:' || bucket, n_chars FROM docs)
SELECT grp, count(*) AS n, round(avg(n_chars), 6) AS mean_n_chars FROM g GROUP BY grp""")
def group_stats(spark, sf_dir):
    out = rel.group_statistics(_docs(spark, sf_dir), rel.overlapping_groups(F.col("difficulty"), F.col("bucket")), ["n_chars"])
    return out.withColumn("mean_n_chars", F.round("mean_n_chars", 6))


@query(f"WITH {DOCS} SELECT coalesce(difficulty, 'all') AS difficulty, coalesce(bucket, 'all') AS bucket, count(*) AS n FROM docs GROUP BY GROUPING SETS ((), (difficulty), (bucket))")
def group_sets(spark, sf_dir):
    _docs(spark, sf_dir).createOrReplaceTempView("cantle_docs")
    return spark.sql("SELECT coalesce(difficulty, 'all') AS difficulty, coalesce(bucket, 'all') AS bucket, count(*) AS n FROM cantle_docs GROUP BY GROUPING SETS ((), (difficulty), (bucket))")


@query(f"""WITH {DOCS}, s AS (
  SELECT *, {fraction_sql('split', 'doc_id')} < 0.8 AS train, difficulty <> 'simple_rectangle' OR {fraction_sql('rectangle', 'doc_id')} < 0.1 AS keep FROM docs
), t AS (
  SELECT 'train_before_filter' AS stage, * FROM s WHERE train UNION ALL SELECT 'train_after_filter', * FROM s WHERE train AND keep UNION ALL SELECT 'validation', * FROM s WHERE NOT train)
SELECT stage, grp, count(*) AS n FROM (SELECT stage, difficulty AS grp FROM t UNION ALL SELECT stage, 'vertices:' || bucket FROM t) GROUP BY stage, grp""")
def split_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("split", hashing.split_of(F.col("doc_id"))).withColumn("keep", hashing.keeps_sample(F.col("doc_id"), F.col("difficulty")))
    train = F.col("split") == "train"
    stages = F.array_compact(F.array(F.when(train, F.lit("train_before_filter")), F.when(train & F.col("keep"), F.lit("train_after_filter")), F.when(~train, F.lit("validation"))))
    return rel.stage_counts(docs, stages, F.array(F.col("difficulty"), F.concat(F.lit("vertices:"), F.col("bucket"))))


@query(f"""WITH {DOCS}, s AS (
  SELECT CASE WHEN {fraction_sql('split', 'doc_id')} >= 0.8 THEN 'validation' WHEN difficulty <> 'simple_rectangle' OR {fraction_sql('rectangle', 'doc_id')} < 0.1 THEN 'train' END AS sink, doc_id FROM docs)
SELECT sink, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM s WHERE sink IS NOT NULL GROUP BY sink""")
def multi_sink_counts(spark, sf_dir):
    """Rows as read back from the two sinks."""
    docs = _docs(spark, sf_dir).withColumn("split", hashing.split_of(F.col("doc_id")))
    keep = hashing.keeps_sample(F.col("doc_id"), F.col("difficulty"))
    root, out = scratch(spark, "sinks"), None
    for name, df in {"train": docs.where((F.col("split") == "train") & keep), "validation": docs.where("split = 'validation'")}.items():
        files.write_jsonl(df, f"{root}/{name}.jsonl")
        back = files.read_jsonl(spark, f"{root}/{name}.jsonl", "doc_id long").select(F.lit(name).alias("sink"), "doc_id")
        out = back if out is None else out.unionByName(back)
    return out.groupBy("sink").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(f"""WITH s AS (SELECT o_custkey, {fraction_sql('split', 'o_orderkey')} < 0.8 AS t FROM orders)
SELECT o_custkey FROM s WHERE t INTERSECT SELECT o_custkey FROM s WHERE NOT t""")
def leakage_check(spark, sf_dir):
    """Customers on both sides of a split by order, which does not keep them apart."""
    orders = ad.table(spark, sf_dir, "orders").select("o_custkey", hashing.split_of(F.col("o_orderkey")).alias("split"))
    return rel.leakage(orders.where("split = 'train'"), orders.where("split = 'validation'"), "o_custkey")


@query(f"""WITH {DOCS} SELECT 'rows_kept' AS name, (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM docs) AS actual, (SELECT count(*) FROM documents) = (SELECT count(*) FROM docs) AS ok
UNION ALL SELECT 'one_line_an_order', (SELECT count(*) FROM orders), (SELECT count(*) FROM lineitem), (SELECT count(*) FROM orders) = (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'diagnostic', (SELECT least(512, count(*)) FROM docs WHERE difficulty = 'complex'), (SELECT count(*) FROM (SELECT 1 FROM docs WHERE difficulty = 'complex' LIMIT 512)), true""")
def gate_checks(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    hard = docs.where("difficulty = 'complex'")
    return rel.gate_checks(
        [
            ("rows_kept", ad.table(spark, sf_dir, "documents").agg(F.count("*")), docs.agg(F.count("*"))),
            ("one_line_an_order", ad.table(spark, sf_dir, "orders").agg(F.count("*")), ad.table(spark, sf_dir, "lineitem").agg(F.count("*"))),
            ("diagnostic", hard.agg(F.least(F.lit(512), F.count("*"))), rel.hash_sample(hard, "doc_id", 512, "diagnostic").agg(F.count("*"))),
        ]
    )


# -- pairing ---------------------------------------------------------------------------------------
def _audit(spark, sf_dir):
    raws = ad.table(spark, sf_dir, "customer").withColumn("raw_name", F.col("c_custkey").cast("string"))
    n = F.lit(raws.count())
    return rel.pair_by_key(ad.pair_targets(spark, sf_dir), raws, "o_orderkey", "key", "c_custkey", n, "name", "raw_name")


@query(f"WITH {TARGETS} SELECT o_orderkey, fk, outcome FROM audit")
def fk_pairing_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


@query(f"""WITH {TARGETS} SELECT count(*) FILTER (WHERE outcome = 'paired') AS paired, count(*) FILTER (WHERE outcome IN ('invalid', 'out_of_range', 'duplicate', 'mismatch')) AS pairing_failures,
count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates FROM audit""")
def prep_counters(spark, sf_dir):
    return _audit(spark, sf_dir).agg(F.count_if(F.col("outcome") == "paired").alias("paired"), F.count_if(F.col("outcome") != "paired").alias("pairing_failures"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount < 0.1)")
def unmatched_anti(spark, sf_dir):
    """Orders that no line names but such as are out of range."""
    outcome = F.when(F.col("l_discount") < 0.1, "paired").otherwise("out_of_range")
    audit = ad.table(spark, sf_dir, "lineitem").select(outcome.alias("outcome"), F.col("l_orderkey").alias("fk"))
    return rel.unmatched(ad.table(spark, sf_dir, "orders").select("o_orderkey"), audit, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY o_orderkey LIMIT 200")
def fid_semi(spark, sf_dir):
    wanted = ad.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return ad.table(spark, sf_dir, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(200)


@query("""WITH a AS (SELECT o_custkey AS k, arg_max(o_orderkey, o_orderkey) AS v FROM orders GROUP BY o_custkey),
b AS (SELECT s_nationkey AS k, arg_max(s_suppkey, s_suppkey) AS v FROM supplier GROUP BY s_nationkey)
SELECT c_custkey, coalesce(a.v, b.v) AS v FROM customer LEFT JOIN a ON c_custkey = a.k LEFT JOIN b ON c_nationkey = b.k""")
def fallback_lookup(spark, sf_dir):
    orders = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("v"))
    suppliers = ad.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("v"))
    return rel.fallback_lookup(ad.table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey"], [orders, suppliers], "v").select("c_custkey", "v")


@query("""WITH p AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS total FROM orders GROUP BY o_custkey)
SELECT c_custkey AS k, total, c_nationkey, total IS NULL AS missing FROM customer LEFT JOIN p ON c_custkey = p.k""")
def three_way_lookup(spark, sf_dir):
    raws = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    preds = ad.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("total"))
    return rel.three_way(raws.select("k"), preds, raws, "k").select("k", F.col("p.total").alias("total"), "c_nationkey", "missing")


@query("""WITH p AS (SELECT vec_id AS k, label, max(vec_id) OVER (PARTITION BY label) AS last FROM embeddings)
SELECT p.k, p.label, p.last, p.k <> p.last AS other, d.n_chars FROM p LEFT JOIN documents d ON d.doc_id = p.k""")
def bucketed_lookup(spark, sf_dir):
    """Documents and vectors kept by their ids: the look-up joins them without an exchange."""
    from cantle.sources import tables

    vectors = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "label")
    last = vectors.groupBy("label").agg(F.max("k").alias("last"))
    docs = tables.by_key(ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("doc_id").alias("ord"), "n_chars"), "k")
    kept = tables.by_key(vectors.join(F.broadcast(last), "label"), "k")  # a row a label
    found = rel.three_way(kept.select("k"), docs, kept, "k")
    return found.select("k", "label", "last", (F.col("k") != F.col("last")).alias("other"), F.col("p.n_chars").alias("n_chars"))


# -- token sequences -------------------------------------------------------------------------------
@query(f"WITH {LINES} SELECT count(*) FILTER (WHERE len(tokens) <= 5) AS kept, count(*) FILTER (WHERE len(tokens) > 5) AS skipped_too_long, CAST(sum(len(tokens)) FILTER (WHERE len(tokens) <= 5) AS BIGINT) AS n_tokens FROM seqs")
def length_filter_stats(spark, sf_dir):
    from cantle.operators import training

    rows = ad.order_sequences(spark, sf_dir).select(F.col("tokens").alias("source_tokens"), F.col("tokens").alias("target_tokens"))
    kept, skipped = training.length_filter(rows, None, 5)
    return kept.agg(F.count("*").alias("kept"), F.sum(F.size("target_tokens")).cast("long").alias("n_tokens")).withColumn("skipped_too_long", F.lit(skipped).cast("long"))


_SEGMENTS = """marked AS (
  SELECT id, i, t, sum(CASE WHEN t = {s} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS g
  FROM (SELECT id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM seqs)
), parts AS (SELECT id, g, list(t ORDER BY i) AS segment FROM marked WHERE t <> {s} GROUP BY id, g HAVING count(*) >= 2)"""


@query(f"WITH {LINES}, {_SEGMENTS.format(s=50)} SELECT id, array_to_string(segment, ',') AS segment FROM parts")
def segments(spark, sf_dir):
    return ad.order_sequences(spark, sf_dir).select("id", F.explode(tokens.segments(F.col("tokens"), F.lit(50))).alias("s")).select("id", F.array_join("s", ",").alias("segment"))


@query(f"WITH {LINES}, parts AS (SELECT tokens AS segment FROM seqs WHERE len(tokens) >= 2) SELECT array_to_string(segment, ',') AS segment, count(*) AS weight FROM parts GROUP BY segment")
def segment_weights(spark, sf_dir):
    return rel.segment_weights(ad.order_sequences(spark, sf_dir), F.col("tokens"), F.col("id")).select(F.array_join("segment", ",").alias("segment"), "weight")


_PAIRS = """pairs AS (
  SELECT t AS l, lead(t) OVER (PARTITION BY id ORDER BY i) AS r FROM (SELECT id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM seqs))"""


@query(f"WITH {EVENTS}, {_PAIRS} SELECT l, r, count(*) AS n FROM pairs WHERE r IS NOT NULL GROUP BY l, r")
def pair_counts(spark, sf_dir):
    return rel.pair_counts(ad.event_sequences(spark, sf_dir), F.col("tokens"))


@query(f"""WITH {EVENTS}, placed AS (
  SELECT id, i, t AS l, lead(t) OVER (PARTITION BY id ORDER BY i) AS r FROM (SELECT id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM seqs))
SELECT l, r, count(*) AS n FROM placed WHERE r IS NOT NULL GROUP BY l, r ORDER BY n DESC, min(struct_pack(id := id, i := i)) LIMIT 1""")
def best_pair(spark, sf_dir):
    return rel.best_pair(ad.event_sequences(spark, sf_dir), F.col("tokens"), F.col("id"))


@query(f"WITH {EVENTS} SELECT id, regexp_replace(regexp_replace(array_to_string(list_transform(tokens, lambda x: 't' || x), ''), 't0t4', 'M', 'g'), 'M', 't1500', 'g') AS merged FROM seqs")
def merge_once(spark, sf_dir):
    t = tokens.merge_once(F.col("tokens"), 0, 4, 1500)
    return ad.event_sequences(spark, sf_dir).select("id", F.array_join(F.transform(t, lambda x: F.concat(F.lit("t"), x.cast("string"))), "").alias("merged"))


@query(f"""WITH {PREDS}, s AS (SELECT id, pred, target, array_to_string(list_transform(pred, lambda x: chr(47 + x)), '') AS a, array_to_string(list_transform(target, lambda x: chr(47 + x)), '') AS b FROM preds)
SELECT id, levenshtein(a, b) AS distance FROM s""")
def edit_distance(spark, sf_dir):
    return ad.predictions(spark, sf_dir).select("id", tokens.edit_distance(F.col("pred"), F.col("target")).cast("long").alias("distance"))


@query(f"""WITH {PREDS}, s AS (SELECT *, array_to_string(list_transform(pred, lambda x: chr(47 + x)), '') AS a, array_to_string(list_transform(target, lambda x: chr(47 + x)), '') AS b,
  coalesce(list_position(pred, 50) - 1, len(pred)) AS pe, coalesce(list_position(target, 50) - 1, len(target)) AS te FROM preds)
SELECT id, CAST(pred = target AS DOUBLE) AS greedy_exact, round(1.0 - levenshtein(a, b) / CAST(greatest(len(pred), len(target), 1) AS DOUBLE), 9) AS token_edit_similarity,
  CAST(abs(len(pred) - len(target)) AS DOUBLE) AS token_length_error, CAST(abs(pe - te) AS DOUBLE) AS eos_position_error FROM s""")
def token_metrics(spark, sf_dir):
    m = tokens.token_metrics(F.col("pred"), F.col("target"), 50)
    m["token_edit_similarity"] = F.round(m["token_edit_similarity"], 9)
    return ad.predictions(spark, sf_dir).select("id", *[v.alias(k) for k, v in m.items()])


@query(f"""WITH {LINES} SELECT id, array_to_string(list_concat(tokens, list_transform(range(greatest(0, 12 - len(tokens))), lambda x: 720)), ',') AS padded,
  array_to_string(tokens[1:len(tokens) - 1], ',') AS input, array_to_string(tokens[2:], ',') AS labels FROM seqs""")
def pad_shift(spark, sf_dir):
    t = F.col("tokens")
    return ad.order_sequences(spark, sf_dir).select("id", F.array_join(tokens.pad_to(t, F.lit(12)), ",").alias("padded"), F.array_join(tokens.teacher_input(t), ",").alias("input"), F.array_join(tokens.teacher_labels(t), ",").alias("labels"))


@query(f"WITH {LINES} SELECT id, array_to_string(tokens, ',') AS stripped, len(tokens) AS n FROM seqs")
def strip_pad(spark, sf_dir):
    padded = tokens.pad_to(F.col("tokens"), F.lit(9))
    return ad.order_sequences(spark, sf_dir).select("id", F.array_join(tokens.strip_pad(padded), ",").alias("stripped"), tokens.target_length(padded).cast("long").alias("n"))


@query(f"""WITH {PREDS}, m AS (SELECT pred = target AS same, len(list_filter(list_zip(pred, target), lambda p: coalesce(p[1] = p[2], false))) AS hit, greatest(len(pred), len(target)) AS n FROM preds)
SELECT count(*) AS sample_count, count(*) FILTER (WHERE same) AS exact_match_count, round(avg(CAST(same AS INT)), 9) AS greedy_exact_match_rate, round(sum(hit) / sum(n), 9) AS token_accuracy FROM m""")
def greedy_metrics(spark, sf_dir):
    found = rel.greedy_rates(ad.predictions(spark, sf_dir), "pred", "target")
    return found.select("sample_count", "exact_match_count", F.round("greedy_exact_match_rate", 9).alias("greedy_exact_match_rate"), F.round("token_accuracy", 9).alias("token_accuracy"))


@query(f"""WITH {LINES}, e AS (SELECT id, i, t, t <> coalesce(lag(t) OVER (PARTITION BY id ORDER BY i), -1) AS new FROM (SELECT id, unnest(list_sort(tokens)) AS t, unnest(range(len(tokens))) AS i FROM seqs)),
g AS (SELECT id, t, sum(CAST(new AS INT)) OVER (PARTITION BY id ORDER BY i) AS g FROM e), r AS (SELECT id, g, t, count(*) AS n FROM g GROUP BY id, g, t)
SELECT id, string_agg(t || 'x' || n, ' ' ORDER BY g) AS runs FROM r GROUP BY id""")
def rle_parse(spark, sf_dir):
    r = F.transform(tokens.runs(F.sort_array("tokens")), lambda e: F.concat(e["d"].cast("string"), F.lit("x"), e["n"].cast("string")))
    return ad.order_sequences(spark, sf_dir).select("id", F.array_join(r, " ").alias("runs"))


@query(f"""WITH {LINES}, e AS (SELECT id, i, t, t <> coalesce(lag(t) OVER (PARTITION BY id ORDER BY i), -1) AS new FROM (SELECT id, unnest(list_transform(list_sort(tokens), lambda x: x // 10)) AS t, unnest(range(len(tokens))) AS i FROM seqs)),
g AS (SELECT id, t, sum(CAST(new AS INT)) OVER (PARTITION BY id ORDER BY i) - 1 AS place FROM e), r AS (SELECT id, CAST(place AS BIGINT) AS place, t, count(*) AS n FROM g GROUP BY ALL)
SELECT id, place, CAST(t AS INT) AS t, n, round(sum(cos(t * 40 * 2 * pi() / 720) * n * 0.2) OVER w, 6) + 0 AS x, round(sum(sin(t * 40 * 2 * pi() / 720) * n * 0.2) OVER w, 6) + 0 AS y FROM r WINDOW w AS (PARTITION BY id ORDER BY place)""")
def table_functions(spark, sf_dir):
    """Runs of the orders' quantities in tens, and the path that they walk, by table functions in SQL."""
    from cantle.functions import tables

    tables.register(spark)
    tens = F.transform(F.sort_array("tokens"), lambda x: F.floor(x / 10).cast("int"))
    ad.order_sequences(spark, sf_dir).select("id", F.posexplode(tens).alias("i", "t")).createOrReplaceTempView("cantle_tens")
    dealt = "PARTITION BY pmod(xxhash64(id), 1024) ORDER BY (id, i)"
    return spark.sql(f"""WITH runs AS (SELECT id, at AS i, t * 40 AS d, n FROM batch_runs(TABLE(cantle_tens) {dealt}))
      SELECT id, i AS place, d DIV 40 AS t, n, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM batch_walk(TABLE(SELECT * FROM runs) {dealt})""").withColumn("t", F.col("t").cast("int"))


@query(f"""WITH {LINES}, v AS (SELECT id, list_transform(tokens, lambda x: CASE x % 10 WHEN 0 THEN x + 719 WHEN 1 THEN 1500 WHEN 2 THEN 1501 ELSE x END) AS l FROM seqs)
SELECT id, len(list_filter(l, lambda x: NOT (x BETWEEN 0 AND 726 OR x = 1500))) AS bad FROM v""")
def token_validity(spark, sf_dir):
    """Directions, ids beyond them, one composite id that the vocabulary has, and one that it has not."""
    rest = F.col("tokens")
    t = F.transform(rest, lambda x: F.when(x % 10 == 0, x + 719).when(x % 10 == 1, 1500).when(x % 10 == 2, 1501).otherwise(x))
    atoms = F.create_map(F.lit(1500), F.array(F.lit(1), F.lit(2)))
    return ad.order_sequences(spark, sf_dir).select("id", tokens.invalid_tokens(t, atoms).cast("long").alias("bad"))


@query(f"""WITH {LINES}, z AS (SELECT id, id % 1000 <> 7 AND (id % 50 <> 0 OR id = 0) AS aligned, id % 13 = 0 OR id % 17 = 0 AS lost, id % 17 = 0 AS bad FROM seqs)
SELECT count(*) FILTER (WHERE aligned) AS n_rows, count(*) FILTER (WHERE aligned AND lost) AS roundtrip_failures, count(*) FILTER (WHERE aligned AND bad) AS invalid_token_count, count(*) FILTER (WHERE NOT aligned) AS row_alignment_failures FROM z""")
def positional_zip_audit(spark, sf_dir):
    """The order key stands in for a file's line number; the coded side has lines missing, of other samples, with wrong and unknown tokens."""
    i, t = F.col("id"), F.col("tokens")
    left = ad.order_sequences(spark, sf_dir).withColumn("n", i)
    wrong = F.concat(F.array(F.element_at(t, 1) + 1), F.slice(t, F.lit(2), F.size(t)))
    coded = F.when(i % 17 == 0, F.concat(t, F.array(F.lit(1600)))).when(i % 13 == 0, wrong).otherwise(t)
    # the pair (1, 2) has an id of its own
    atoms = F.create_map(F.lit(1500), F.array(F.lit(1), F.lit(2)))
    pair = tokens.merge_once(coded, 1, 2, 1500)
    right = left.where("id % 1000 <> 7").withColumn("tokens", pair).withColumn("id", F.when(i % 50 == 0, -i).otherwise(i))
    return rel.lossless_audit(rel.zip_by_place(left, right, "n", "id"), atoms, ["tokens"])


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, doc_id FROM documents), lost AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1),
b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, doc_id FROM documents WHERE doc_id <> (SELECT doc_id FROM lost))
SELECT coalesce(a.line, b.line) AS line, a.doc_id AS left_id, b.doc_id AS right_id, coalesce(a.doc_id = b.doc_id, false) AS aligned FROM a FULL JOIN b ON a.line = b.line""")
def line_zip(spark, sf_dir):
    """Two files of all documents by line number; one lacks the line of the longest, so that all later lines are misaligned."""
    from cantle.sources import lines

    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lost = docs.orderBy(F.desc("n_chars"), "doc_id").limit(1).select("doc_id")
    root, sides = scratch(spark, "lines"), []
    for name, df in {"left": docs, "right": docs.join(lost, "doc_id", "left_anti")}.items():
        files.write_jsonl(lines.in_order(df.withColumn("line", F.col("doc_id"))), f"{root}/{name}.jsonl")
        sides.append(lines.line_file(spark, f"{root}/{name}.jsonl").parsed("doc_id long"))
    zipped = rel.zip_by_place(*sides, "line", "doc_id")
    return zipped.select(F.coalesce("a.line", "b.line").alias("line"), F.col("a.doc_id").alias("left_id"), F.col("b.doc_id").alias("right_id"), "aligned")


@query("SELECT event_id, value AS start_x, -value AS rotation_deg, CAST(json_extract(props, '$.k') AS INT) AS start_vertex_index, value / 2 AS inner_x, 2 AS inner_n FROM events")
def parse_frame_json(spark, sf_dir):
    v, k = F.col("value"), F.get_json_object("props", "$.k")
    parts = [F.lit('{"start_x":'), v, F.lit(',"start_y":0.5,"ref_x":1,"ref_y":2,"rotation_deg":'), -v, F.lit(',"longest_edge_m":3.5,"start_vertex_index":'), k, F.lit(',"inner_starts":[['), v / 2, F.lit(",1.5],[7,8]]}")]
    frames = ad.table(spark, sf_dir, "events").select("event_id", F.from_json(F.concat(*[x.cast("string") for x in parts]), FRAME_DDL).alias("f"))
    return frames.select("event_id", "f.start_x", "f.rotation_deg", "f.start_vertex_index", F.col("f.inner_starts")[0][0].alias("inner_x"), F.size("f.inner_starts").alias("inner_n"))


# -- evaluation ------------------------------------------------------------------------------------
_EVAL = """m AS (
  SELECT id, CASE WHEN len(target) > 4 THEN 'complex' ELSE 'simple' END AS difficulty, CASE WHEN len(target) <= 4 THEN '4' WHEN len(target) <= 8 THEN '5-8' WHEN len(target) <= 16 THEN '9-16' ELSE '17+' END AS bucket,
    len(pred) > 1 AS pok, len(target) > 1 AS tok, CASE WHEN len(pred) > 1 AND len(target) > 1 THEN least(len(pred), len(target)) / CAST(greatest(len(pred), len(target)) AS DOUBLE) END AS iou,
    CASE WHEN id % 7 = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(abs(len(pred) - len(target)) AS DOUBLE) END AS err FROM preds
), g AS (SELECT 'overall' AS grp, * FROM m UNION ALL SELECT difficulty, * FROM m UNION ALL SELECT 'vertices:' || bucket, * FROM m)"""


@query(f"""WITH {PREDS}, {_EVAL} SELECT grp, count(*) AS sample_count, count(*) FILTER (WHERE NOT pok) AS invalid_geometry_count, round(count(*) FILTER (WHERE NOT pok) / CAST(count(*) AS DOUBLE), 9) AS invalid_geometry_rate,
 count(*) FILTER (WHERE NOT tok) AS invalid_reference_count, round(count(*) FILTER (WHERE NOT tok) / CAST(count(*) AS DOUBLE), 9) AS invalid_reference_rate, round(avg(iou), 9) AS iou, round(avg(err) FILTER (WHERE isfinite(err)), 9) AS err,
 round(coalesce(sum(iou), 0) / nullif(count(*) FILTER (WHERE tok), 0), 9) AS all_sample_outline_iou FROM g GROUP BY grp""")
def eval_groups(spark, sf_dir):
    p, t = F.size("pred"), F.size("target")
    rows = ad.predictions(spark, sf_dir).select(
        F.when(t > 4, "complex").otherwise("simple").alias("difficulty"),
        rings.vertex_bucket(t).alias("bucket"),
        (p > 1).alias("pok"),
        (t > 1).alias("tok"),
        F.when((p > 1) & (t > 1), F.least(p, t) / F.greatest(p, t)).alias("iou"),
        F.when(F.col("id") % 7 == 0, float("inf")).otherwise(F.abs(p - t).cast("double")).alias("err"),
    )
    out = rel.evaluation_report(rows, rel.overlapping_groups(F.col("difficulty"), F.col("bucket")), ["iou", "err"], "pok", "tok", "iou")
    return out.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, round(-l_discount - 6 * greatest(0.16 - l_tax, l_tax - 0.20, 0) - 0.8 * abs(ln(greatest(1 - l_discount, 0.000001))), 9) AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey) AS k FROM b) SELECT l_orderkey, max(score) AS score FROM r WHERE k = 1 GROUP BY l_orderkey""")
def best_candidate(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem")
    # the share of removed vertices comes as tax, the area ratio as what the discount leaves
    score = rings.candidate_score(-F.col("l_discount"), F.lit(1.0), F.lit(1.0) - F.col("l_tax"), F.lit(1.0) - F.col("l_discount"), 5000) + 1.0
    scored = li.select("l_orderkey", F.round(score, 9).alias("score"), F.struct("l_linenumber", "l_partkey").alias("rank"))
    return rel.best_per_group(scored, ["l_orderkey"], "score", "rank").select("l_orderkey", "score")


@query("""SELECT event_type AS split, CAST(event_id AS INT) AS epoch, value AS greedy_exact_match_rate FROM events WHERE value >= 0 AND event_type IN ('view', 'click')
ORDER BY CASE event_type WHEN 'view' THEN 0 ELSE 1 END, value DESC, event_id LIMIT 1""")
def best_checkpoint(spark, sf_dir):
    """The events as a metrics log, appended to in two parts: views are test rows, clicks training rows, other kinds neither."""
    events = ad.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "test").when(F.col("event_type") == "click", "train").otherwise(F.col("event_type"))
    log = events.select(kind.alias("split"), F.col("event_id").cast("int").alias("epoch"), F.col("value").alias("greedy_exact_match_rate"))
    path = scratch(spark, "metrics")
    files.append_metrics(log.where("split = 'train'"), path)
    files.append_metrics(log.where("split <> 'train'"), path)
    best = rel.best_checkpoint(files.read_jsonl(spark, path, "split string, epoch int, greedy_exact_match_rate double"))
    return best.withColumn("split", F.when(F.col("split") == "test", "view").otherwise("click"))


@query("""SELECT page_id, CASE WHEN contains(m, 'empty') OR contains(m, 'zero area') THEN 'empty_geometry' WHEN contains(m, 'not polygon') OR contains(m, 'no polygon') THEN 'non_polygon'
 WHEN contains(m, 'invalid') OR contains(m, 'self-intersection') THEN 'invalid_geometry' WHEN contains(m, 'ring') OR contains(m, 'token') OR contains(m, 'candidate') THEN 'decode_error' ELSE 'other_error' END AS category
FROM (SELECT page_id, lower(CASE page_id % 5 WHEN 0 THEN 'Empty ' WHEN 1 THEN 'NO polygon ' WHEN 2 THEN 'Invalid ' WHEN 3 THEN 'bad ring ' ELSE '' END || url) AS m FROM pages)""")
def failure_category(spark, sf_dir):
    k = F.col("page_id") % 5
    prefix = F.when(k == 0, "Empty ").when(k == 1, "NO polygon ").when(k == 2, "Invalid ").when(k == 3, "bad ring ").otherwise("")
    return ad.table(spark, sf_dir, "pages").select("page_id", rings.failure_category(F.concat(prefix, F.col("url"))).alias("category"))


# -- rings -----------------------------------------------------------------------------------------
@query(f"WITH {STARS} SELECT id, i, ((CAST(round(atan2(dy, dx) / (2 * pi() / 720)) AS BIGINT) % 720) + 720) % 720 AS direction, greatest(1, CAST(round(len / 0.2) AS BIGINT)) AS steps FROM edge")
def quantize_edges(spark, sf_dir):
    e = ad.stars(spark, sf_dir).select("id", F.posexplode(rings.edges(F.col("ring"))).alias("i", "e"))
    return e.select("id", F.col("i").cast("long").alias("i"), rings.quantize_direction(F.col("e.dx"), F.col("e.dy")).cast("long").alias("direction"), rings.quantize_length(F.col("e.len")).cast("long").alias("steps"))


@query(f"WITH {STARS} SELECT id, round(sum(x * y2 - x2 * y) / 2, 6) AS area, round(sum(len), 6) AS perimeter, count(*) AS vertices FROM edge GROUP BY id")
def ring_area_perimeter(spark, sf_dir):
    r = F.col("ring")
    return ad.stars(spark, sf_dir).select("id", F.round(rings.area(r), 6).alias("area"), F.round(rings.perimeter(r), 6).alias("perimeter"), rings.vertex_count(F.array(r)).cast("long").alias("vertices"))


@query(f"WITH {STARS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(len, 9) DESC, i) AS k FROM edge) SELECT id, i AS idx, round(len, 6) AS len, round(degrees(atan2(dy, dx)), 6) AS angle FROM r WHERE k = 1")
def longest_edge(spark, sf_dir):
    e = ad.stars(spark, sf_dir).select("id", rings.longest_edge(F.col("ring")).alias("e"))
    return e.select("id", F.col("e.idx").cast("long").alias("idx"), F.round("e.len", 6).alias("len"), F.round("e.angle_deg", 6).alias("angle"))


@query(f"WITH {STARS}, r AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY round(sqrt((x - 9) * (x - 9) + (y - 3) * (y - 3)), 9), i) AS k FROM pts) SELECT id, i FROM r WHERE k = 1")
def closest_vertex(spark, sf_dir):
    return ad.stars(spark, sf_dir).select("id", rings.closest_vertex(F.col("ring"), F.lit(9.0), F.lit(3.0)).cast("long").alias("i"))


@query(f"WITH {STARS} SELECT id, round(sum(x * y2 - x2 * y) / 2, 6) AS area, CAST(true AS BOOLEAN) AS ccw FROM edge GROUP BY id")
def orient_ccw(spark, sf_dir):
    back = rings.oriented(F.when(F.col("id") % 2 == 0, F.reverse("ring")).otherwise(F.col("ring")))
    return ad.stars(spark, sf_dir).select("id", F.round(rings.signed_area(back), 6).alias("area"), (rings.signed_area(back) > 0).alias("ccw"))


@query(f"WITH {STARS} SELECT id, rtrim(string_agg(repeat((((CAST(round(atan2(dy, dx) / (2 * pi() / 720)) AS BIGINT) % 720) + 720) % 720) || ',', CAST(greatest(1, CAST(round(len / 0.2) AS BIGINT)) AS INT)), '' ORDER BY i), ',') AS tokens FROM edge GROUP BY id")
def unary_encode(spark, sf_dir):
    return ad.stars(spark, sf_dir).select("id", F.array_join(rings.unary_tokens(F.col("ring")), ",").alias("tokens"))


@query(f"""WITH {LINES}, e AS (SELECT id, unnest(tokens) AS d, unnest(range(len(tokens))) AS i FROM seqs)
, s AS (SELECT id, sum(cos(d * 10 * (2 * pi() / 720)) * 0.6) AS x, sum(sin(d * 10 * (2 * pi() / 720)) * 0.6) AS y FROM e GROUP BY id)
SELECT id, CASE WHEN sqrt(x * x + y * y) <= 0.1 THEN 0 ELSE round(x, 6) + 0 END AS x, CASE WHEN sqrt(x * x + y * y) <= 0.1 THEN 0 ELSE round(y, 6) + 0 END AS y FROM s""")
def walk_ring(spark, sf_dir):
    r = F.transform("tokens", lambda t: F.struct((t * 10).alias("d"), F.lit(3).alias("n")))
    path = rings.walk(r, F.lit(0.0), F.lit(0.0))
    # the last point before the closing one, or the start itself where the end snapped to it
    end = F.when(F.size(path) == F.size(r) + 2, F.element_at(path, -2)).otherwise(F.element_at(path, -1))
    return ad.order_sequences(spark, sf_dir).select("id", (F.round(end["x"], 6) + 0.0).alias("x"), (F.round(end["y"], 6) + 0.0).alias("y"))


@query(f"""WITH {LINES}, e AS (SELECT id, i, d, d <> coalesce(lag(d) OVER (PARTITION BY id ORDER BY i), -1) AS new FROM (SELECT id, unnest(list_transform(tokens, lambda t: t // 25)) AS d, unnest(range(len(tokens))) AS i FROM seqs)),
g AS (SELECT id, d, sum(CAST(new AS INT)) OVER (PARTITION BY id ORDER BY i) AS g FROM e), r AS (SELECT id, g, d, count(*) * 2 AS n FROM g GROUP BY id, g, d)
SELECT id, string_agg(d || 'x' || n, ' ' ORDER BY g) AS merged FROM r GROUP BY id""")
def merge_edges(spark, sf_dir):
    r = F.transform("tokens", lambda t: F.struct(F.floor(t / 25).cast("int").alias("d"), F.lit(2).alias("n")))
    out = F.transform(rings.merge_edges(r), lambda e: F.concat(e["d"].cast("string"), F.lit("x"), e["n"].cast("string")))
    return ad.order_sequences(spark, sf_dir).select("id", F.array_join(out, " ").alias("merged"))


@query(f"WITH {STARS} SELECT id, i, round(3 + (x - 3) * cos(radians(37)) - (y + 2) * sin(radians(37)), 6) AS x, round(-2 + (x - 3) * sin(radians(37)) + (y + 2) * cos(radians(37)), 6) AS y FROM pts")
def rotate_points(spark, sf_dir):
    p = ad.stars(spark, sf_dir).select("id", F.posexplode(rings.rotate_about(F.col("ring"), F.lit(37.0), F.lit(3.0), F.lit(-2.0))).alias("i", "p"))
    return p.select("id", F.col("i").cast("long").alias("i"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""WITH k AS (SELECT 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n), c AS (
  SELECT n, 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) * 0.9996 AS s, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3, 2 * sqrt(n) / (1 + n) AS e FROM k
), p AS (SELECT c_custkey, c.*, sin(radians(34.05 + c_custkey * 0.00001)) AS f, radians(-118.25 + c_custkey * 0.00001 + 117) AS l FROM customer, c
), t AS (SELECT *, sinh(0.5 * ln((1 + f) / (1 - f)) - e * 0.5 * ln((1 + e * f) / (1 - e * f))) AS t FROM p
), x AS (SELECT *, atan2(t, cos(l)) AS xi, 0.5 * ln((1 + sin(l) / sqrt(1 + t * t)) / (1 - sin(l) / sqrt(1 + t * t))) AS eta FROM t)
SELECT c_custkey, round(500000 + s * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS east,
 round(s * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS north FROM x""")
def utm_project(spark, sf_dir):
    k = F.col("c_custkey") * 0.00001
    east, north = rings.utm(F.lit(-118.25) + k, F.lit(34.05) + k, 11)
    return ad.table(spark, sf_dir, "customer").select("c_custkey", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("""WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, 1.0 + p_partkey % 7 AS h, 1.0 - (p_partkey % 10) / 20.0 AS f FROM part)
SELECT p_partkey, round(f * f, 6) AS outline_iou, round(abs(f * f - 1), 6) AS area_relative_error, round(abs(f - 1), 6) AS perimeter_relative_error, round(f * f, 6) AS minimum_rectangle_iou, round(abs(f - 1), 6) AS long_error FROM b""")
def rect_iou(spark, sf_dir):
    """Polygon metrics of boxes that share a corner, which have closed forms."""
    from cantle.operators import geometry

    w, h, f = F.col("p_size").cast("double"), 1.0 + F.col("p_partkey") % 7, 1.0 - (F.col("p_partkey") % 10) / 20.0
    pair = ad.table(spark, sf_dir, "part").select("p_partkey", geometry.as_parts(ad.box(F.lit(0.0), F.lit(0.0), w * f, h * f)).alias("a"), geometry.as_parts(ad.box(F.lit(0.0), F.lit(0.0), w, h)).alias("b"))
    wanted = ["outline_iou", "area_relative_error", "perimeter_relative_error", "minimum_rectangle_iou", "minimum_rectangle_long_error"]
    # a small file is one partition, and a pair takes half a millisecond
    found = geometry.compare_valid(pair.repartition(2 * spark.sparkContext.defaultParallelism), "p_partkey", "a", "b", wanted)
    near = lambda c: F.round(F.round(c, 9), 6)
    names = ["outline_iou", "area_relative_error", "perimeter_relative_error", "minimum_rectangle_iou"]
    return found.select("p_partkey", *[near(c).alias(c) for c in names], near("minimum_rectangle_long_error").alias("long_error"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 3 <> 0 AS simple, round(degrees(acos((l_quantity * l_linenumber) / (l_quantity * sqrt(l_linenumber * l_linenumber + 1.0)))), 6) AS corner FROM lineitem""")
def simple_rectangle(spark, sf_dir):
    """Boxes, every third with a vertex on a side, and the angle at the foot of a slope of 1 in the line's number."""
    b = ad.boxes(spark, sf_dir)
    ring = ad.box(F.col("x0"), F.lit(0.0), F.col("w"), F.col("h"))
    mid = F.struct((F.col("x0") + F.col("w") / 2).alias("x"), F.lit(0.0).alias("y"))
    ring = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.slice(ring, 1, 1), F.array(mid), F.slice(ring, 2, 3))).otherwise(ring)
    foot, line = F.element_at(ring, 1), F.col("l_linenumber").cast("double")
    along = F.struct((foot["x"] + F.col("w")).alias("x"), foot["y"].alias("y"))
    slope = F.struct((foot["x"] + line).alias("x"), (foot["y"] + 1.0).alias("y"))
    corner = F.round(rings.angle_degrees(along, foot, slope), 6)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", rings.simple_rectangle(ring).alias("simple"), corner.alias("corner"))


@query("""SELECT event_id, round(least(((abs(value - user_id) % 180) + 180) % 180, 180 - ((abs(value - user_id) % 180) + 180) % 180), 6) AS err,
 CASE WHEN event_id % 2 = 0 THEN 725 ELSE 726 END AS token FROM events""")
def angle_tests(spark, sf_dir):
    scale = F.when(F.col("event_id") % 2 == 0, 5000).otherwise(10000)
    return ad.table(spark, sf_dir, "events").select("event_id", F.round(rings.angle_error(F.col("value"), F.col("user_id")), 6).alias("err"), tokens.scale_token(scale).alias("token"))


@query("SELECT CAST(sum(octet_length(encode(n_name)) + 1) AS BIGINT) AS n_bytes, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS digest, count(*) AS lines FROM nation")
def artifact_fingerprint(spark, sf_dir):
    """The fingerprint of a written file of names, which is the one part of its folder."""
    path = scratch(spark, "names") + ".txt"
    ad.table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return files.parts(spark, path).select(F.col("bytes").alias("n_bytes"), F.col("sha256").alias("digest"), "lines")


@query("""WITH p AS (SELECT label, string_agg(CAST(vec_id AS VARCHAR) || chr(10), '' ORDER BY vec_id) AS body, count(*) AS n FROM embeddings GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, octet_length(encode(body)) AS n_bytes, sha256(body) AS digest, n AS lines FROM p""")
def part_fingerprints(spark, sf_dir):
    """A file of ids for each label, hashed where it lies by the executors."""
    root = scratch(spark, "parts")
    ids = ad.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").cast("string").alias("id"), "vec_id")
    ids.repartition(F.col("label")).sortWithinPartitions("label", "vec_id").select("label", "id").write.partitionBy("label").text(root)
    found = files.parts(spark, root)
    return found.select(F.regexp_extract("name", r"label=(\d+)/", 1).cast("long").alias("label"), F.col("bytes").alias("n_bytes"), F.col("sha256").alias("digest"), "lines")


# -- vocabularies, polygons and models ---------------------------------------------------------------
def _vocabulary(spark, sf_dir, size=1540):
    from cantle.operators import bpe

    return bpe.train_from(ad.event_sequences(spark, sf_dir), ["tokens"], "id", size=size)


def _merges_sql(steps: int, most: int = 10) -> str:
    """Merging one pair at a time over strings, one character a token: pairs are counted anew at each step; of equal
    counts the pair first seen, where its later token was made, from the left."""
    chars = "string_split(s, '')"
    pairs = "SELECT id, i, c[i] AS l, c[i + 1] AS r FROM (SELECT id, c, unnest(range(1, len(c))) AS i FROM (SELECT id, {} AS c FROM s{}))"
    out = f"""{EVENTS}, s0 AS MATERIALIZED (SELECT id, array_to_string(list_transform(tokens, lambda t: chr(65 + t)), '') AS s FROM seqs),
seen0 AS MATERIALIZED (SELECT l, r, 0 AS m, min(struct_pack(id := id, i := i)) AS f FROM ({pairs.format(chars, 0)}) GROUP BY l, r),
tok0 AS MATERIALIZED (SELECT chr(CAST(65 + t AS INT)) AS t, 1 AS n, CAST(t AS VARCHAR) AS atoms FROM range(5) x(t))"""
    for k in range(steps):
        new = f"chr({20000 + k})"
        places = f"SELECT id, c, unnest(list_filter(range(1, len(c) + 1), lambda i: c[i] = {new})) AS i FROM (SELECT id, {chars} AS c FROM s{k + 1})"
        out += f""", best{k} AS MATERIALIZED (
  SELECT p.l, p.r, a.n + b.n AS n, a.atoms || ' ' || b.atoms AS atoms FROM (SELECT l, r, count(*) AS n FROM ({pairs.format(chars, k)}) GROUP BY l, r) p
  JOIN seen{k} USING (l, r) JOIN tok{k} a ON a.t = l JOIN tok{k} b ON b.t = r WHERE a.n + b.n <= {most} ORDER BY p.n DESC, m, f LIMIT 1),
s{k + 1} AS MATERIALIZED (SELECT id, replace(s, l || r, {new}) AS s FROM s{k}, best{k}),
seen{k + 1} AS MATERIALIZED (SELECT * FROM seen{k} UNION ALL SELECT l, r, {k + 1}, min(f) FROM (
  SELECT c[i - 1] AS l, {new} AS r, struct_pack(id := id, i := 2 * i) AS f FROM ({places}) WHERE i > 1
  UNION ALL SELECT {new}, CASE WHEN c[i + 1] = {new} THEN b.l ELSE c[i + 1] END, struct_pack(id := id, i := 2 * i + 1) FROM ({places}), best{k} b WHERE i < len(c)) GROUP BY l, r),
tok{k + 1} AS MATERIALIZED (SELECT * FROM tok{k} UNION ALL SELECT {new}, n, atoms FROM best{k})"""
    return f"WITH {out} SELECT CAST(unicode(t) - 20000 + 1500 AS INT) AS id, atoms FROM tok{steps} WHERE n > 1"


@query(_merges_sql(40))
def bpe_vocab(spark, sf_dir):
    """Forty merges over the events of all users."""
    v = _vocabulary(spark, sf_dir)
    return spark.createDataFrame([(i, " ".join(map(str, a))) for i, a in sorted(v.atoms.items())], "id int, atoms string")


# -- layers ------------------------------------------------------------------------------------------
def _star_layer(spark, sf_dir):
    """The stars side by side, written as a layer in the order of their ids; its path."""
    import os

    from cantle.operators import geometry
    from cantle.sources import shapefile_sink

    folder = files.local_path(scratch(spark, "layer"))
    os.makedirs(folder)
    labels = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    aside = F.transform("ring", lambda p: F.struct((p["x"] + 60.0 * F.col("id")).alias("x"), p["y"].alias("y")))
    stars = ad.stars(spark, sf_dir).join(labels, "id").select("id", "label", geometry.as_parts(aside).alias("geom"))
    shapefile_sink.write(stars, f"{folder}/stars.shp", [("id", "N", 12, 0), ("label", "N", 4, 0)], 'PROJCS["plane",UNIT["Meter",1.0]]', "id")
    return f"{folder}/stars.shp"


@query(f"""WITH {STARS} SELECT row_number() OVER (ORDER BY edge.id) - 1 AS fid, edge.id, CAST(any_value(label) AS BIGINT) AS label,
 round(sum(x * y2 - x2 * y) / 2, 3) AS area, round(sum(len), 3) AS perimeter, count(*) AS vertices FROM edge JOIN embeddings ON vec_id = edge.id GROUP BY edge.id""")
def layer_sink_scan(spark, sf_dir):
    """A layer written by the executors and read back, place and attributes included."""
    from cantle.sources import shapefile

    r = F.col("geom")[0][0]
    found = shapefile.read(spark, _star_layer(spark, sf_dir), records=2000)
    return found.select("fid", "id", "label", F.round(rings.area(r), 3).alias("area"), F.round(rings.perimeter(r), 3).alias("perimeter"), F.size(r).cast("long").alias("vertices"))


@query(f"""WITH {STARS}, box AS (SELECT id, min(x) + 60 * id AS x0, max(x) + 60 * id AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY id)
SELECT id, CAST(label AS BIGINT) AS label, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x1, 3) AS x1, round(y1, 3) AS y1 FROM box JOIN embeddings ON vec_id = id
WHERE label >= 3 AND label <> 5 AND x0 <= 20000 AND x1 >= 1000 AND y0 <= 7.5 AND y1 >= 2.5""")
def layer_window_scan(spark, sf_dir):
    """A window of the layer: the box index leaves out partitions, labels are tested before boxes, shapes are not read."""
    from cantle.sources import shapefile

    found = shapefile.read(spark, _star_layer(spark, sf_dir), ["id", "label", "box"], window=(1000.0, 2.5, 20000.0, 7.5), records=2000)
    return found.where("label >= 3 AND label <> 5").select("id", "label", *[F.round(f"box.{c}", 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


#: Fixed composite tokens of the queries that encode event kinds (0 to 4).
_COMPOSITES = {1500: (0, 4), 1501: (0, 4, 0), 1502: (4, 4), 1503: (2, 2, 4), 1504: (4, 0, 4, 0, 1)}


def _longest_match_sql() -> str:
    names = {"".join(map(str, a)): i for i, a in _COMPOSITES.items()}
    pattern = "|".join([*sorted(names, key=len, reverse=True), "[0-4]"])
    cases = " ".join(f"WHEN '{n}' THEN {i}" for n, i in names.items())
    return f"list_transform(regexp_extract_all(array_to_string(tokens, ''), '{pattern}'), lambda m: CASE m {cases} ELSE CAST(m AS INT) END)"


@query(f"WITH {EVENTS} SELECT id, array_to_string({_longest_match_sql()}, ',') AS coded, array_to_string(tokens, ',') AS tokens FROM seqs")
def bpe_encode_roundtrip(spark, sf_dir):
    from cantle.operators import bpe

    v = bpe.Vocabulary(dict(_COMPOSITES), 1500, 6000, 10)
    coded = bpe.encode_columns(ad.event_sequences(spark, sf_dir), v, ["tokens"])
    back = bpe.decode_columns(coded.withColumn("coded", F.array_join("tokens", ",")), v, ["tokens"])
    return back.select("id", "coded", F.array_join("tokens", ",").alias("tokens"))


@query(f"WITH {EVENTS} SELECT id, array_to_string({_longest_match_sql()}, ',') AS coded, array_to_string(tokens, ',') AS tokens FROM seqs")
def bpe_encode_native(spark, sf_dir):
    by_atoms = F.create_map(*[x for i, a in _COMPOSITES.items() for x in (F.lit(",".join(map(str, a))), F.lit(i))])
    atoms = F.create_map(*[x for i, a in _COMPOSITES.items() for x in (F.lit(i), F.array(*map(F.lit, a)))])
    coded = ad.event_sequences(spark, sf_dir).select("id", tokens.bpe_encode(F.col("tokens"), by_atoms, max(map(len, _COMPOSITES.values()))).alias("c"))
    return coded.select("id", F.array_join("c", ",").alias("coded"), F.array_join(tokens.bpe_decode(F.col("c"), atoms), ",").alias("tokens"))


_COMMON = """SELECT a.id, a.side, -0.5 * sum(a.s * b.s * w * CASE WHEN da * db >= 0 THEN abs(da + db) / 2 ELSE (da * da + db * db) / (2 * (abs(da) + abs(db))) END) AS common FROM (
    SELECT a, b, least(a.r, b.r) - greatest(a.l, b.l) AS w, (a.y + a.m * (greatest(a.l, b.l) - a.l)) - (b.y + b.m * (greatest(a.l, b.l) - b.l)) AS da,
      (a.y + a.m * (least(a.r, b.r) - a.l)) - (b.y + b.m * (least(a.r, b.r) - b.l)) AS db
    FROM {0} a JOIN {0} b ON a.id = b.id AND a.side = 0 AND b.side = 1 AND greatest(a.l, b.l) < least(a.r, b.r)) GROUP BY a.id, a.side"""
_SPANS = "SELECT id, side, least(x, x2) AS l, greatest(x, x2) AS r, CASE WHEN x < x2 THEN y ELSE y2 END AS y, (y2 - y) / (x2 - x) AS m, CASE WHEN x < x2 THEN 1.0 ELSE -1.0 END AS s FROM {} WHERE x <> x2"
_NEAREST = """SELECT id, side, {0} AS d FROM (SELECT p.id, p.side, p.n, min(sqrt(pow(p.x - e.x - t * (e.x2 - e.x), 2) + pow(p.y - e.y - t * (e.y2 - e.y), 2))) AS d FROM (
    SELECT p, e, greatest(0.0, least(1.0, ((p.x - e.x) * (e.x2 - e.x) + (p.y - e.y) * (e.y2 - e.y)) / (e.len * e.len))) AS t FROM {1} p JOIN e ON p.id = e.id AND p.side <> e.side) GROUP BY p.id, p.side, p.n) GROUP BY id, side"""
_METRICS = f"""WITH {STARS}, v AS (SELECT id, 0 AS side, i, x, y FROM pts UNION ALL SELECT id, 1, i, x * 1.1, y * 0.9 + 1.0 FROM pts
), e AS (SELECT p.*, q.x AS x2, q.y AS y2, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) AS len FROM v p JOIN v q ON p.id = q.id AND p.side = q.side AND q.i = (p.i + 1) % 64
), whole AS (SELECT id, side, sum(x * y2 - x2 * y) / 2 AS area, sum(len) AS len FROM e GROUP BY id, side
), sp AS ({_SPANS.format("e")}), shared AS ({_COMMON.format("sp")}
), summed AS (SELECT *, sum(len) OVER (PARTITION BY id, side ORDER BY i) AS ending FROM e
), placed AS (SELECT *, coalesce(lag(ending) OVER (PARTITION BY id, side ORDER BY i), 0) AS starting, max(ending) OVER (PARTITION BY id, side) AS total FROM summed
), samples AS (SELECT id, side, k AS n, x + (k / 128.0 * total - starting) / len * (x2 - x) AS x, y + (k / 128.0 * total - starting) / len * (y2 - y) AS y
  FROM placed JOIN range(128) r(k) ON k / 128.0 * total >= starting AND k / 128.0 * total < ending
), corners AS (SELECT id, side, i AS n, x, y FROM v
), mean AS ({_NEAREST.format("avg(d)", "samples")}), far AS ({_NEAREST.format("max(d)", "corners")}
), ways AS (SELECT p.id, p.side, p.i, p.x, p.y, (q.x - p.x) / sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) AS ux, (q.y - p.y) / sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) AS uy, q.x AS qx, q.y AS qy
  FROM v p JOIN v q ON p.id = q.id AND p.side = q.side AND p.i <> q.i
), around AS (SELECT w.id, w.side, w.i, any_value(w.ux) AS ux, any_value(w.uy) AS uy, min(k.x * w.ux + k.y * w.uy) AS s0, max(k.x * w.ux + k.y * w.uy) AS s1, min(k.y * w.ux - k.x * w.uy) AS t0, max(k.y * w.ux - k.x * w.uy) AS t1
  FROM ways w JOIN v k ON k.id = w.id AND k.side = w.side GROUP BY w.id, w.side, w.i, w.qx, w.qy HAVING bool_and((w.qx - w.x) * (k.y - w.y) - (w.qy - w.y) * (k.x - w.x) >= 0)
), box AS (SELECT * FROM around QUALIFY row_number() OVER (PARTITION BY id, side ORDER BY (s1 - s0) * (t1 - t0), i) = 1
), boxed AS (SELECT id, side, greatest(s1 - s0, t1 - t0) AS long, least(s1 - s0, t1 - t0) AS short, (s1 - s0) * (t1 - t0) AS area, ((degrees(atan2(uy, ux)) + CASE WHEN s1 - s0 >= t1 - t0 THEN 0 ELSE 90 END) % 180 + 180) % 180 AS angle FROM box
), ends AS (SELECT id, side, k, ux * CASE WHEN k IN (0, 3) THEN s0 ELSE s1 END - uy * CASE WHEN k < 2 THEN t0 ELSE t1 END AS x, uy * CASE WHEN k IN (0, 3) THEN s0 ELSE s1 END + ux * CASE WHEN k < 2 THEN t0 ELSE t1 END AS y FROM box, range(4) r(k)
), be AS (SELECT p.id, p.side, p.x, p.y, q.x AS x2, q.y AS y2 FROM ends p JOIN ends q ON p.id = q.id AND p.side = q.side AND q.k = (p.k + 1) % 4
), bsp AS ({_SPANS.format("be")}), bshared AS ({_COMMON.format("bsp")})
SELECT p.id, round(c.common / (p.area + q.area - c.common), 6) AS outline_iou, round((m0.d + m1.d) / 2, 6) AS mean_boundary_distance, round(greatest(f0.d, f1.d), 6) AS hausdorff_distance,
 round(abs(p.len - q.len) / q.len, 6) AS perimeter_relative_error, round(abs(p.area - q.area) / q.area, 6) AS area_relative_error, round(d.common / (b0.area + b1.area - d.common), 6) AS minimum_rectangle_iou,
 round(least(abs(b0.angle - b1.angle) % 180, 180 - abs(b0.angle - b1.angle) % 180), 6) AS minimum_rectangle_angle_error_deg, round(abs(b0.long - b1.long) / b1.long, 6) AS minimum_rectangle_long_error, round(abs(b0.short - b1.short) / b1.short, 6) AS minimum_rectangle_short_error
FROM whole p JOIN whole q ON p.id = q.id AND p.side = 0 AND q.side = 1 JOIN shared c ON c.id = p.id JOIN bshared d ON d.id = p.id JOIN mean m0 ON m0.id = p.id AND m0.side = 0 JOIN mean m1 ON m1.id = p.id AND m1.side = 1
 JOIN far f0 ON f0.id = p.id AND f0.side = 0 JOIN far f1 ON f1.id = p.id AND f1.side = 1 JOIN boxed b0 ON b0.id = p.id AND b0.side = 0 JOIN boxed b1 ON b1.id = p.id AND b1.side = 1"""


@query(_METRICS)
def polygon_metrics(spark, sf_dir):
    """Stars against the same ones stretched and moved: all nine metrics, many pairs at a time."""
    from cantle.operators import geometry

    grown = F.transform("ring", lambda p: F.struct((p["x"] * 1.1).alias("x"), (p["y"] * 0.9 + 1.0).alias("y")))
    pairs = ad.stars(spark, sf_dir, dealt=True).select("id", geometry.as_parts(F.col("ring")).alias("a"), geometry.as_parts(grown).alias("b"))
    found = geometry.compare_stacked(pairs, "id", "a", "b")
    return found.select("id", *[F.round(c, 6).alias(c) for c in found.columns if c != "id"])


@query()
def codec_roundtrip(spark, sf_dir):
    from cantle.operators import geometry

    return geometry.round_trip(ad.stars(spark, sf_dir).select("id", geometry.as_parts(F.col("ring")).alias("geom")), "id", "geom")


@query("""WITH b AS (SELECT s_suppkey, 5.0 + s_nationkey AS w, 3.0 + s_suppkey % 7 AS h, (5.0 + s_nationkey) * (1.0 - (s_suppkey % 4) * 0.04) AS v FROM supplier),
q AS (SELECT *, greatest(1, floor(w / 0.2 + 0.5 + 1e-9)) AS nw, greatest(1, floor(h / 0.2 + 0.5 + 1e-9)) AS nh, greatest(1, floor(v / 0.2 + 0.5 + 1e-9)) AS nv FROM b)
SELECT s_suppkey AS target_fid, s_suppkey AS raw_fid, 'simple_rectangle' AS difficulty, 4 AS source_vertex_count, CAST(2 * (nw + nh) + 3 AS INT) AS n_source, CAST(2 * (nv + nh) + 2 AS INT) AS n_target,
 round(common / (nv * 0.2 * nh * 0.2 + v * h - common), 3) AS outline_iou, CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, least(nh * 0.2, h) * CASE WHEN h > w THEN least(w, v) - greatest(0, w - nv * 0.2) ELSE least(nv * 0.2, v) END AS common FROM q)""")
def prepare_pairs(spark, sf_dir):
    """A box higher than wide is turned, so its tokens start at the lower right corner, and those of a narrower target, too."""
    from cantle.operators import geometry

    w, h, shrink = 5.0 + F.col("s_nationkey"), 3.0 + F.col("s_suppkey") % 7, 1.0 - (F.col("s_suppkey") % 4) * 0.04
    one = ad.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("target_fid"),
        F.col("s_suppkey").alias("raw_fid"),
        F.col("s_suppkey").cast("string").alias("osm_id"),
        geometry.as_parts(ad.box(F.lit(500000.0), F.lit(3760000.0), w, h)).alias("raw"),
        geometry.as_parts(ad.box(F.lit(500000.0), F.lit(3760000.0), w * shrink, h)).alias("target"),
    )
    return geometry.prepare_pairs(one, 5000).select("target_fid", "raw_fid", "difficulty", "source_vertex_count", F.size("source_tokens").alias("n_source"), F.size("target_tokens").alias("n_target"), F.round("tokenization_metrics.outline_iou", 3).alias("outline_iou"), "error")


def _small_model():
    from cantle.functions import seq2seq

    shape = seq2seq.Shape(vocab=800, width=16, heads=2, layers=1, inner=32)
    return seq2seq.random_weights(shape, 5), shape


@query()
def seq2seq_greedy(spark, sf_dir):
    from cantle.operators import inference

    seqs = ad.order_sequences(spark, sf_dir).withColumnRenamed("tokens", "source_tokens")
    out = inference.greedy_predictions(seqs, *_small_model())
    return out.select("id", F.array_join("pred_tokens", ",").alias("pred_tokens"), F.size("pred_tokens").alias("n_pred"))


@query()
def seq2seq_beam(spark, sf_dir):
    from cantle.operators import bpe, geometry, inference

    stars = ad.stars(spark, sf_dir).select(F.col("id").alias("fid"), geometry.as_parts(F.col("ring")).alias("geom"))
    # about a second a row, so few rows a task
    dealt = stars.repartition(4 * spark.sparkContext.defaultParallelism, "fid")
    found = inference.candidates(dealt, *_small_model(), bpe.Vocabulary({}), 5000)
    return found.select("raw_fid", "beam_rank", F.round("model_score", 6).alias("model_score"), F.col("error").isNull().alias("decoded"))


@query("""WITH e AS (SELECT date_trunc('hour', ts) AS start, 'overall' AS grp, value FROM events UNION ALL SELECT date_trunc('hour', ts), event_type, value FROM events)
SELECT start, grp, count(*) AS n, round(avg(value), 6) AS mean_value FROM e GROUP BY start, grp""")
def windowed_groups(spark, sf_dir):
    from cantle.streaming.evaluation import windowed_groups as grouped

    out = grouped(ad.table(spark, sf_dir, "events"), "ts", F.array(F.lit("overall"), F.col("event_type")), ["value"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "grp", "n", F.round("mean_value", 6).alias("mean_value"))
