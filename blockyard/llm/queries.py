"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockyard.llm.common import read_table
from blockyard.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.simhash import simhash_components
    found = simhash_components(read_table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.mixing import mixing_plan
    plan = mixing_plan(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken",
                       F.get("positions", F.lit(0)).alias("first_position")) \
        .orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.decontaminate import contamination
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op7_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM items WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, p.n, s, item_id FROM places p JOIN wins USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids
  FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.sharding import assign_shards, number_slots
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    slim = materialize(assign_shards(slim, "doc_id", 8), "sharding")
    placed = assign_shards(number_slots(slim, "doc_id"), "doc_id", 9, "grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.toxicity import toxicity
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.warc import read_archives, write_pages
    folder = write_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    # responses are read with their payloads, which are checked against their digests; revisits by their headers
    whole = read_archives(spark, folder).where("record_type = 'response'")
    heads = read_archives(spark, folder, payload=False).where("record_type = 'revisit'")
    cols = [page(F.col("record_id")).alias("page_id"), "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to")]
    return whole.select(F.octet_length("payload").cast("long").alias("payload_bytes"), *cols) \
        .unionByName(heads.select("payload_bytes", *cols))


_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {0}, 5))::INT >> {1}) % 32 + 1, 1)"
ORACLES["op5_warc"] = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, {' || '.join(_LETTER.format(i // 4 * 5 + 1, 5 * (3 - i % 4)) for i in range(32))} AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""


def _tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.token_counts import section_tokens
    return section_tokens(read_table(spark, sf_dir, "documents"), _tokenizer())


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.token_files import ids_crc32, read_documents, write_token_files
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), _tokenizer())
    return read_documents(manifest, ids_crc32, "ids_crc32 bigint")


@query
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.embeddings import near_vectors
    return near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.95)


ORACLES["op6_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings LEFT JOIN degree d ON d.x = vec_id JOIN roots r ON r.x = vec_id
"""


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.substrings import repeated_spans
    found = repeated_spans(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.quality import quality
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.common import words
    from blockyard.llm.periodic import longest, periodic_runs
    docs = read_table(spark, sf_dir, "documents")
    # the contract plants a period in one document of ten
    h = F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8"))

    def planted(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.when(n > 0, g % F.greatest(n, F.lit(1)))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        pick = F.transform(w, lambda _, i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.array_join(pick, " ")
    text = F.when(h % 10 == 0, F.transform(F.array(words(docs["text"])), planted)[0]).otherwise(docs["text"])
    found = periodic_runs(docs.select("doc_id", text.alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    found = found.select("key", "n_words", F.size("runs").cast("long").alias("n_runs"), longest(F.col("runs")).alias("best"),
                         F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_runs", F.col("best")["start"].alias("start"),
                        F.col("best")["length"].alias("length"), F.col("best")["period"].alias("period"),
                        F.floor(1000 * F.col("best")["length"] / F.col("best")["period"]).alias("exponent_milli"),
                        "runs_sha256", "collapsed_sha256")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockyard.llm.conversations import numbered_turns, prefix_trie, rebuilt_turns
    c = F.col("conv_id")
    opening = F.crc32(F.encode(c.cast("string"), "UTF-8")) % 6
    return prefix_trie(*rebuilt_turns(numbered_turns(read_table(spark, sf_dir, "conversations")), c - c % 100, opening, 5))


# crc32 bit by bit: each character is followed by eight shifts (-1)
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''),
  lambda ch: list_concat([ascii(ch)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
ORACLES["op11_prefix_trie"] = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(t ORDER BY i) AS turns FROM own GROUP BY conv_id),
opened AS (SELECT *, {_CRC32.format("conv_id::VARCHAR")} % 6 AS h FROM whole),
built AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS s
  FROM opened a LEFT JOIN whole b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefixes AS (SELECT conv_id, s, d, s[1:d] AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM built)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
  FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * length(n.p[n.d].t) ELSE 0 END AS saved,
    up.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN kids k USING (p, d) LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]),
above AS (SELECT p[1:a] AS p, a AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM full_nodes JOIN above USING (p, d)
"""
