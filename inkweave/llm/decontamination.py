"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

Words of the training documents are posted as (term, document, position). Benchmark items are matched from their
rarest terms: of each window of an item's words the two places whose terms the corpus has least often are looked up,
their positions are shifted by their offsets in the item, and the shifted lists are intersected: a document can hold the
window only if both meet on one diagonal (position less offset). Only terms that are looked up are stored, and only
documents whose lists meet are compared word by word. The text of each document is read by narrow stages; what is
shuffled are postings of rare terms and candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.llm.store import written

#: A list of this many short rows at most is sent to every executor; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
_NO_ID = 2**63 - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of letters, digits and everything beyond ASCII, A-Z in lower case; null for a null text."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _GAP), "")


def _small(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if its size is known to be small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): the mark tells different texts of one id apart."""
    text = F.col(text_col).cast("string")
    identity = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    return documents.select(identity.alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def postings(documents: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: (term, id, mark, position) of every occurrence of the given terms, counted from 0."""
    rows = _keyed(documents, id_col, text_col).select("id", "mark", F.posexplode(words_of(F.col("text"))).alias("position", "term"))
    return rows.join(terms, "term", "left_semi")


def _item_words(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct word sequences with a key each, and (key, item) of all items; items without words are left out."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col).cast("string")).alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("key", F.sha2(F.array_join("w", " "), 256))
    return rows.groupBy("key").agg(F.first("w").alias("w")), rows.select("key", "item").distinct()


def _anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(key, term, offset, single): of each window the two places with the rarest terms; windows with an unknown term cannot occur."""
    starts = F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")
    windows = items.select("key", F.size("w").alias("n"), "w", F.explode(starts).alias("start"))
    places = windows.select("key", "start", F.least("n", F.lit(window)).alias("length"), F.posexplode(F.expr(f"slice(w, start + 1, {window})")).alias("at", "term"))
    rated = places.join(counts, "term", "left")
    ranked = rated.groupBy("key", "start", "length").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "term", (F.col("start") + F.col("at")).alias("offset")))).alias("ranked")
    )
    possible = ranked.where("ranked[0].rows > 0")
    chosen = possible.select("key", (F.col("length") == 1).alias("single"), F.explode(F.slice("ranked", 1, 2)).alias("place"))
    return chosen.select("key", "place.term", "place.offset", "single").distinct()


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """One row per input document: ``id``, ``n_words``, ``n_hit``, ``item_ids``, ``places``, ``contaminated``.

    A document word is hit if it lies in an occurrence of ``window`` consecutive words of an item; an item of fewer
    words, but not none, is one window. ``n_hit`` counts hit words, ``item_ids`` are the items with an occurring
    window (as strings, ascending as strings), ``places`` are the occurrences as (begin, length) in words.

    A null or empty text has no words and no hit; null or empty items match nothing; an item without an id marks
    words but has no place in ``item_ids``. Repeated rows get the same result each, texts that share an id are told
    apart, and a document without an id is looked at like any other (its ``id`` stays null). Other columns are left
    out, so clashing names do not matter. Empty tables give an empty result, or one without hits.
    """
    rows = _keyed(documents, id_col, text_col)
    items, owners = _item_words(benchmark, item_col, item_text_col)
    items = written(items, "items")
    terms = _small(items.select(F.explode("w").alias("term")).distinct())
    counts = written(postings(documents, terms, id_col=id_col, text_col=text_col).groupBy("term").agg(F.count("*").alias("rows")), "term-counts")
    anchors = written(_anchors(items, counts, window), "anchors")

    index = postings(documents, _small(anchors.select("term").distinct()), id_col=id_col, text_col=text_col)
    met = index.join(_small(anchors), "term").select("id", "mark", "key", (F.col("position") - F.col("offset")).alias("diagonal"), "offset", "single")
    # two places of a window on one diagonal; a window of one word needs only the one
    meeting = met.groupBy("id", "mark", "key", "diagonal").agg(
        F.min("offset").alias("low"), F.max("offset").alias("high"), F.max("single").alias("single")
    )
    candidates = written(meeting.where("low < high or single").select("id", "mark", "key", "diagonal", "low", "high"), "candidates")

    listed = candidates.join(items, "key").groupBy("id", "mark").agg(F.collect_list(F.struct("key", "w", "diagonal", "low", "high")).alias("candidates"))
    looked_at = rows.join(_small(candidates.select("id", "mark").distinct()), ["id", "mark"], "left_semi").distinct()
    compared = looked_at.select("id", "mark", words_of(F.col("text")).alias("d")).join(listed, ["id", "mark"])
    found = compared.select("id", "mark", F.explode(_occurrences(window)).alias("hit")).select("id", "mark", "hit.*")
    found = written(found, "occurrences")

    places = found.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("begin", "length"))).alias("places"))
    covered = F.expr("size(array_distinct(flatten(transform(places, p -> sequence(p.begin, p.begin + p.length - 1)))))")
    places = places.select("id", "mark", "places", covered.cast("long").alias("n_hit"))
    named = found.select("id", "mark", "key").distinct().join(owners, "key").groupBy("id", "mark").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    counted = rows.select("id", "mark", F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long").alias("n_words"))
    counted = counted.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    hits = places.join(named, ["id", "mark"], "left")
    joined = counted.join(hits, ["id", "mark"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        "places",
        (n_hit > 0).alias("contaminated"),
    )


def _occurrences(window: int) -> Column:
    """The windows of a document's candidates that occur on their diagonals, as (key, begin, length)."""
    return F.expr(f"""
        flatten(transform(candidates, c -> transform(
            filter(
                sequence(greatest(0, c.low - {window - 1}), least(c.high, greatest(size(c.w) - {window}, 0))),
                s -> s + c.diagonal >= 0 and s + c.diagonal + least({window}, size(c.w)) <= size(d)
                    and slice(d, s + c.diagonal + 1, least({window}, size(c.w))) = slice(c.w, s + 1, least({window}, size(c.w)))
            ),
            s -> struct(c.key as key, s + c.diagonal as begin, least({window}, size(c.w)) as length)
        )))
    """)


def near_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    within: int = 8,
) -> DataFrame:
    """(id, item, first, second): places where the two rarest terms of an item's stretch lie within ``within`` words of each other.

    Proximity matches find items that were reworded: the terms may come in either order. The stretches are all runs of
    ``within`` + 1 words of an item, or the whole of a shorter one, so a copy of any stretch matches. The rarest terms
    are two different terms of the stretch that the corpus has, by their counts; stretches of one such term match
    nothing. ``first`` is the place of the rarer one. Null texts and items match nothing; repeated rows match once.
    """
    items, owners = _item_words(benchmark, item_col, item_text_col)
    items = written(items, "items")
    terms = _small(items.select(F.explode("w").alias("term")).distinct())
    index = postings(documents, terms, id_col=id_col, text_col=text_col).distinct()
    counts = written(index.groupBy("term").agg(F.count("*").alias("rows")), "term-counts")
    pairs = written(_pairs(items, counts, within), "pairs")
    chosen = pairs.select(F.col("before").alias("term")).distinct()

    # each place is compared with the next ones of its document only: no more than ``within`` of them are near enough
    index = postings(documents, _small(chosen), id_col=id_col, text_col=text_col)
    listed = index.groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.struct("position", "term"))).alias("places"))
    near = F.expr(f"""
        flatten(transform(places, (x, i) -> transform(
            filter(slice(places, i + 2, {within}), y -> y.position - x.position <= {within} and y.term != x.term),
            y -> struct(x.term as before, y.term as after, x.position as at, y.position as next)
        )))
    """)
    neighbours = listed.select("id", "mark", F.explode(near).alias("hit")).select("id", "mark", "hit.*")
    met = neighbours.join(_small(pairs), ["before", "after"])
    placed = met.select(
        "key", "id", F.when(F.col("in_order"), F.col("at")).otherwise(F.col("next")).alias("first"),
        F.when(F.col("in_order"), F.col("next")).otherwise(F.col("at")).alias("second"),
    )
    found = placed.join(owners, "key")
    return found.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("id"), "item", "first", "second").distinct()


def _pairs(items: DataFrame, counts: DataFrame, within: int) -> DataFrame:
    """(key, before, after, in_order): the two rarest terms of each stretch of an item, both ways round; in_order has the rarer first."""
    starts = F.expr(f"sequence(0, greatest(size(w) - {within + 1}, 0))")
    stretches = items.select("key", "w", F.explode(starts).alias("start"))
    terms = stretches.select("key", "start", F.explode(F.array_distinct(F.expr(f"slice(w, start + 1, {within + 1})"))).alias("term"))
    rated = terms.join(counts, "term").groupBy("key", "start").agg(F.slice(F.sort_array(F.collect_list(F.struct("rows", "term"))), 1, 2).alias("rare"))
    pairs = rated.where("size(rare) = 2").select("key", F.expr("rare[0].term").alias("one"), F.expr("rare[1].term").alias("two")).distinct()
    ways = F.expr("array(struct(one as before, two as after, true as in_order), struct(two as before, one as after, false as in_order))")
    return pairs.select("key", F.explode(ways).alias("way")).select("key", "way.*")
