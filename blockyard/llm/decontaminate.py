"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockyard.llm.common import ascii_lower, words
from blockyard.session import materialize

#: Words are runs of digits, a-z and non-ASCII characters, after lower-casing A-Z.
#: The class [^\x00-\x2F\x3A-\x60\x7B-\x7F] with each character listed: Java looks single characters up in a table, but
#: tests the ranges of a negated class one by one, which takes ten times as long.
ALNUM = "[^" + "".join(f"\\x{c:02x}" for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)) + "]+"
#: Words of a shingle; items shorter than that are searched by single words.
SHINGLE = 5


def _words(text: Column) -> Column:
    return words(ascii_lower(text), ALNUM)


def _shingles(word_hashes: Column, width: int) -> Column:
    """Hashes of all runs of `width` words, by position; empty if there are fewer words."""
    n = F.size(word_hashes)
    run = lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(width)])
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), run)) \
        .otherwise(F.expr("cast(array() as array<bigint>)"))


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(item, win): every run of `window` words of each item, or all its words if it has fewer but not none."""
    w = items.select(F.col(key).alias("item"), _words(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.least(n, F.lit(window))))).alias("win"))


def contamination(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """One row per row of docs: its key (as `doc_id`), n_words, n_hit (words inside an occurrence of an item window),
    n_items (items of which a window occurs), items_sha256 (of their keys, sorted as strings, joined by commas), and
    contaminated (n_hit > 0 and share * n_hit >= n_words).

    Containment is exact, so the necessary prefix of a window is its rarest shingle. The corpus is read once for the
    places of all item shingles; their counts order the shingles by rarity; places of each window's rarest shingle,
    shifted by its place in the window, are the candidates that the length of the document allows; and their words
    are compared with the window's. The item tables are broadcast only if what was written is under Spark's
    threshold; beyond it the joins are dealt out by shingle, and adaptive execution splits frequent ones.

    Null and wordless texts have no words, and no window if they are items. Rows with equal key and text have equal
    results. Item rows with a null key hit words but are not listed. An empty item table leaves every document clean;
    an empty document table gives no rows; other columns do not matter."""
    t = F.coalesce(F.col(doc_text), F.lit(""))
    base = docs.select(F.col(doc_key).alias("doc"), F.xxhash64(t, F.lit(0)).alias("t0"), F.col(doc_text).alias("text"))
    wins = materialize(item_windows(items, item_key, item_text, window).distinct(), "decon-windows")
    found = _occurrences(base, wins.select("win").distinct())
    found = materialize(found, "decon-found")

    # words covered by the union of the occurrences
    by_doc = Window.partitionBy("doc", "t0").orderBy("start", "len")
    covered = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest(
        F.col("start"), F.coalesce(F.max(F.col("start") + F.col("len")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    spans = found.select("doc", "t0", "start", F.size("win").alias("len")).groupBy("doc", "t0", "start").agg(F.max("len").alias("len"))
    hits = spans.withColumn("covered", covered).groupBy("doc", "t0").agg(F.sum("covered").cast("long").alias("n_hit"))
    owners = wins.where(F.col("item").isNotNull()).select(F.col("win").alias("w"), F.col("item").cast("string").alias("item"))
    listed = found.select("doc", "t0", "win").distinct().join(owners, F.col("win") == F.col("w")) \
        .groupBy("doc", "t0").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    verdict = materialize(_join_null_safe(hits, listed), "decon-verdict")
    sizes = base.select("doc", "t0", F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.expr("cast(array() as array<string>)"))
    return _join_null_safe(sizes, verdict).select(
        F.col("doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((F.coalesce("n_hit", F.lit(0)) > 0) & (F.lit(share) * F.coalesce("n_hit", F.lit(0)) >= F.col("n_words"))).alias("contaminated"))


def _join_null_safe(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on (doc, t0), null keys equal."""
    r = right.withColumnsRenamed({"doc": "_d", "t0": "_t"})
    return left.join(r, left.doc.eqNullSafe(r["_d"]) & (left.t0 == r["_t"]), "left").drop("_d", "_t")


def _occurrences(base: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc, t0, start, win): all places where a window occurs in a document."""
    wins = wins.withColumn("width", F.when(F.size("win") >= SHINGLE, F.lit(SHINGLE)).otherwise(F.lit(1))) \
        .withColumn("wh", F.transform("win", lambda x: F.xxhash64(x)))
    # the shingles of each window with their offsets
    grams = wins.withColumn("g", F.when(F.col("width") == SHINGLE, _shingles(F.col("wh"), SHINGLE)).otherwise(_shingles(F.col("wh"), 1))) \
        .select("win", "width", F.posexplode("g").alias("off", "gram"))
    grams = materialize(grams, "decon-grams")
    hashed = base.select("doc", "t0", F.transform(_words(F.col("text")), lambda x: F.xxhash64(x)).alias("wh"))
    places = None
    for width in (SHINGLE, 1):
        wanted = materialize(grams.where(F.col("width") == width).select(F.col("gram").alias("want")).distinct(), "decon-wanted")
        at = hashed.select("doc", "t0", F.size("wh").alias("n"), F.posexplode(_shingles(F.col("wh"), width)).alias("pos", "gram")) \
            .join(wanted, F.col("gram") == F.col("want")).select("doc", "t0", "n", "pos", "gram", F.lit(width).alias("width"))
        places = at if places is None else places.unionByName(at)
    places = materialize(places, "decon-places")
    # rarity: how often each shingle occurs in the corpus; a window whose rarest shingle never occurs is dropped
    count = materialize(places.groupBy("width", "gram").agg(F.count("*").alias("n_places")), "decon-counts")
    ranked = grams.join(count, ["width", "gram"], "left") \
        .groupBy("win", "width").agg(F.min(F.struct(F.coalesce("n_places", F.lit(0)).alias("n"), "gram", "off")).alias("a"))
    anchors = materialize(ranked.where("a.n > 0").select("win", "width", "a.gram", "a.off", F.size("win").alias("len")), "decon-anchors")
    start = F.col("pos") - F.col("off")
    near = places.join(anchors, ["width", "gram"]).withColumn("start", start) \
        .where((start >= 0) & (start + F.col("len") <= F.col("n"))) \
        .groupBy("doc", "t0").agg(F.collect_set(F.struct("start", "win")).alias("near"))
    near = materialize(near, "decon-near").withColumnsRenamed({"doc": "_d", "t0": "_t"})
    # the candidates' own words, read again for their documents only
    texts = base.join(near, base.doc.eqNullSafe(near["_d"]) & (base.t0 == near["_t"])).select("doc", "t0", _words(F.col("text")).alias("w"), "near")
    equal = F.filter("near", lambda c: F.slice("w", c["start"] + 1, F.size(c["win"])) == c["win"])
    return texts.select("doc", "t0", F.explode(equal).alias("c")).select("doc", "t0", "c.start", "c.win")


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are not contaminated. All rows of a key go if one of them is contaminated; rows with a null key
    are one key; null and empty texts have no words and stay. Columns are passed through, whatever their names; without
    items all rows stay; an empty table gives no rows."""
    found = contamination(docs, items, doc_key=key, **options)
    bad = materialize(found.where("contaminated").select(F.col("doc_id").alias("_bad")).distinct(), "decon-bad")
    return docs.join(bad, docs[key].eqNullSafe(bad["_bad"]), "left_anti")
