"""One query per operator, with production parameters over whole tables, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_work_dir, work_root
from . import bpe_codec, decontamination, importance, language_mixture, license_scan, line_dedup, ngram_join, spelling, suffix_dedup, token_counts, token_files, toxicity, vector_caps
from .common import batch_of, byte_values, join_rows, text_key, text_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            work_root(spark)
            return build(lambda table: spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


def _sha(text) -> F.Column:
    return F.sha2(text, 256)


def remainder(divisor: int) -> F.Column:
    """crc32 of an id as text, modulo a number: the rule that sets folds apart."""
    return F.crc32(F.col("id").cast("string")) % divisor


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.train(documents, labels, usable=remainder(5) != 0)


@query("op1_toxicity")
def op1(read) -> DataFrame:
    documents = read("documents")
    scored = toxicity.score_documents(documents, toxicity_model(documents, read("labels")))
    return scored.select(
        F.col("id").alias("doc_id"), (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("evidence").alias("nearest_examples"),
    )


@query(
    "op2_vector_caps",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x FOR x IN embedding IF x <> 0]) > 0),
    links AS (
      SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    reach(x, root) AS (
      SELECT vec_id, vec_id FROM embeddings UNION SELECT y, root FROM reach JOIN links USING (x) WHERE root < y),
    roots AS (SELECT x, min(root) AS root FROM reach GROUP BY 1),
    sums AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
    FROM embeddings JOIN roots ON vec_id = roots.x LEFT JOIN sums ON vec_id = sums.x
    """,
)
def op2(read) -> DataFrame:
    linked = vector_caps.vector_links(read("embeddings"))
    return linked.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query(
    "op4_benchmark_decontamination",
    r"""
    WITH d AS (
      SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
    b AS (
      SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
    bw AS (
      SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS v
      FROM b, LATERAL unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (
      SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS v
      FROM d, sizes, LATERAL unnest(range(1, len(w) - n + 2)) AS t(s)),
    hits AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (n, v)),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL unnest(range(s, s + n)) AS t(p) GROUP BY 1),
    found AS (
      SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op4(read) -> DataFrame:
    documents = read("documents")
    hits = decontamination.benchmark_hits(documents, read("benchmark"))
    # One row per document: repeated rows get the result of their (id, text).
    rows = text_rows(documents, "doc_id", "text").select("id", text_key())
    return join_rows(rows, hits).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        _sha(F.array_join("items", ",")).alias("items_sha256"), decontamination.contaminated().alias("contaminated"),
    )


@query(
    "op9_line_dedup",
    r"""
    WITH l AS (
      SELECT doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
    k AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    hot AS (
      SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
    m AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN hot USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op9(read) -> DataFrame:
    kept = line_dedup.deduplicate_lines(read("documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", _sha(F.col("text")).alias("kept_sha256"))


TOKEN_LIMIT = 2048


@query("op5_token_counts")
def op5(read) -> DataFrame:
    counts = token_counts.token_counts(read("documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _code_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of ids and decoded texts."""
    for batch in batches:
        ids = [x.tolist() for x in bpe_codec.id_arrays(batch.column("ids"))]
        digests = [sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
        texts = [sha256(t).hexdigest() for t in byte_values(batch.column("text"))]
        yield batch_of(_CODED, batch.column("id"), [len(x) for x in ids], digests, texts)



def coded(documents: DataFrame) -> DataFrame:
    return bpe_codec.round_trip(
        documents, public_tokenizers.path("byte_bpe_50k.json"), then=_code_digests,
        ddl="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


@query("op6_bpe_codec")
def op6(read) -> DataFrame:
    return coded(read("documents"))


@query("op7_language_id")
def op7(read) -> DataFrame:
    documents = read("documents")
    model = language_mixture.train(documents, usable=remainder(4) != 2)
    mixed = language_mixture.infer(documents, model)
    return mixed.select(
        F.col("id").alias("doc_id"), (remainder(4) == 2).alias("held_out"), F.col("language").alias("lang_pred"), "score",
        "languages", "shares",
    )


@query(
    "op10_ngram_join",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
    sh AS (
      SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS v
      FROM d, LATERAL unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(s) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (v) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
      SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
    reach(x, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, root FROM reach JOIN links USING (x) WHERE root < y)
    SELECT reach.x AS doc_id, coalesce(max(n), 0) AS n_shingles, min(root) AS component_id
    FROM reach LEFT JOIN n ON doc_id = reach.x GROUP BY 1
    """,
)
def op10(read) -> DataFrame:
    linked = ngram_join.linked_documents(read("documents"))
    return linked.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op3_suffix_dedup")
def op3(read) -> DataFrame:
    kept = suffix_dedup.remove_repeats(read("documents"))
    return kept.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("span_starts").cast("long").alias("n_spans"), _sha(F.col("kept")).alias("kept_sha256"),
    )


@query("op8_license_scan")
def op8(read) -> DataFrame:
    documents = read("documents")
    scanned = license_scan.scan_documents(documents, license_scan.train(documents))
    return scanned.select(
        F.col("id").alias("doc_id"), "n_paragraphs", F.array_sort(F.array_distinct("families")).alias("families"),
        F.size("families").cast("long").alias("n_confirmed"), "n_unconfirmed",
        F.coalesce(F.array_max("confidences"), F.lit(0.0)).alias("score"),
    )


# CRC-32 in SQL: a table of 256 entries, folded over the bytes of a text's hexadecimal form.
_CRC_TABLE = """
    steps(k, b, v) AS (
      SELECT 0, b, b FROM range(256) AS t(b)
      UNION ALL SELECT k + 1, b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE k < 8),
    crc_table AS (SELECT list(v ORDER BY b) AS c FROM steps WHERE k = 8)"""


def _crc_sql(digits: str) -> str:
    """SQL of the CRC-32 of the bytes whose hexadecimal digits a column holds; ``c`` is the table."""
    octets = f"[CAST('0x' || substr({digits}, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len({digits}) // 2)]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda x, y: xor(x // 256, c[xor(x, y) % 256 + 1])), 4294967295)"


@query(
    "op11_importance_resampling",
    rf"""
    WITH RECURSIVE {_CRC_TABLE},
    texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
    w AS (
      SELECT side, id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM texts),
    f AS (
      SELECT side, id, unnest(w) AS f FROM w
      UNION ALL SELECT side, id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w),
    bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
    crcs AS (SELECT f, {_crc_sql("h")} % 10000 AS bucket FROM bytes, crc_table),
    placed AS (SELECT side, id, bucket FROM f JOIN crcs USING (f)),
    counts AS (
      SELECT b AS bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
      FROM range(10000) AS r(b) LEFT JOIN placed ON bucket = b GROUP BY 1),
    sums AS (SELECT count(*) FILTER (side = 0) AS s_all, count(*) FILTER (side = 1) AS t_all FROM placed),
    gains AS (
      SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
      FROM counts, sums),
    weights AS (
      SELECT id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
      FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY 1),
    noise AS (
      SELECT id, len(w) >= 20 AS long_enough, CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) AS DOUBLE)
        + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS noise FROM w WHERE side = 0),
    scored AS (
      SELECT id, long_enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + noise AS score
      FROM noise LEFT JOIN weights USING (id)),
    drawn AS (
      SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place, count(*) OVER () AS n FROM scored WHERE long_enough)
    SELECT scored.id AS doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
    FROM scored LEFT JOIN drawn USING (id)
    """,
)
def op11(read) -> DataFrame:
    ranks = importance.importance_ranks(read("documents"), read("benchmark"))
    return ranks.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query(
    "op12_spelling_variants",
    rf"""
    WITH RECURSIVE {_CRC_TABLE},
    found AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    runs AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS digits FROM found WHERE length(run) >= 6 GROUP BY 1, 2),
    hashed AS (SELECT run, n, {_crc_sql("digits")} AS h FROM runs, crc_table),
    slipped AS (
      SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
    cuts AS (
      SELECT word, n, substr(word, 1, i) || '_' || substr(word, i + 2) AS replaced, substr(word, 1, i) || substr(word, i + 2) AS deleted
      FROM words, LATERAL unnest(range(length(word))) AS t(i)),
    shorter AS (SELECT DISTINCT cuts.word AS a, cuts.n AS a_n, words.word AS b, words.n AS b_n FROM cuts JOIN words ON deleted = words.word),
    near AS (
      SELECT a.word AS word, a.n AS n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (replaced) WHERE a.word <> b.word
      UNION ALL SELECT a, a_n, b, b_n FROM shorter UNION ALL SELECT b, b_n, a, a_n FROM shorter),
    counts AS (SELECT word, count(*) AS n_near FROM near GROUP BY 1),
    best AS (SELECT word, n, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
    forms AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE place = 1 AND near_n >= 5 * n),
    paths(word, endpoint) AS (SELECT word, word FROM words UNION ALL SELECT paths.word, form FROM paths JOIN forms ON endpoint = forms.word),
    roots AS (SELECT paths.word AS word, endpoint AS root FROM paths LEFT JOIN forms ON endpoint = forms.word WHERE form IS NULL)
    SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n
    FROM words JOIN roots USING (word) LEFT JOIN counts USING (word) LEFT JOIN forms USING (word)
    """,
)
def op12(read) -> DataFrame:
    return spelling.spelling_variants(read("documents"))


@query("op13_token_files")
def op13(read) -> DataFrame:
    documents = read("documents")
    path = new_work_dir(documents.sparkSession, "tokens")
    corpus = token_files.round_trip(documents, public_tokenizers.path("word_bpe_49k.json"), path)
    return corpus.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
