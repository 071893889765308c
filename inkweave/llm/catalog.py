"""The registered queries of this subpackage: each applies one operator to its whole table.

Digest columns are derived here from the operators' real outputs; where SQL can express a query, its SQL is in ORACLE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm import (
    chat_tree,
    conversation_trie,
    decontamination,
    language_id,
    mixing,
    near_dedup,
    posting_ann,
    pseudonyms,
    quality_trees,
    substring_dedup,
    suffix_dedup,
    url_cascade,
    whitening,
)
from inkweave.llm.store import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_substring_dedup(spark, folder):
    cut = substring_dedup.remove_repeats(table(spark, folder, "documents"), window=13)
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE["op1_substring_dedup"] = r"""
WITH said AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos, w FROM said WHERE len(w) >= 13
), keyed AS (
    SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS words FROM windows
), repeated AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY words) AS first FROM keyed) WHERE first < doc_id
), gone AS (
    SELECT doc_id, list(DISTINCT pos + k) AS places FROM repeated, (SELECT unnest(range(13)) AS k) GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.places), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(
        CASE WHEN g.places IS NULL THEN s.w ELSE
            list_transform(list_filter(list_zip(s.w, range(1, len(s.w) + 1)), lambda p: NOT list_contains(g.places, p[2])), lambda p: p[1])
        END, ' ')) AS kept_sha256
FROM said s LEFT JOIN gone g USING (doc_id)
"""


@query
def op3_suffix_array_dedup(spark, folder):
    cut = suffix_dedup.remove_repeated_bytes(table(spark, folder, "documents"), length=50)
    return cut.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op5_minhash_near_dedup(spark, folder):
    found = near_dedup.near_duplicates(table(spark, folder, "documents"), shingle=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def class_of(modulus: int) -> Column:
    """The checksum class of a document: classes are told apart before anything is learned."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@query
def op6_quality_trees(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality_trees.train(documents, labels, class_of(4) != 2)
    held_out = documents.select("doc_id", "text", F.coalesce(class_of(4) == 2, F.lit(False)).alias("held_out"))
    scored = quality_trees.score(held_out, model, also=("held_out",))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query
def op10_language_id(spark, folder):
    documents = table(spark, folder, "documents")
    model = language_id.train(documents, class_of(3) != 1)
    found = language_id.identify(documents, model)
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op8_benchmark_decontamination(spark, folder):
    found = decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE["op8_benchmark_decontamination"] = r"""
WITH said AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), asked AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[pos:pos + 9], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM asked WHERE len(w) > 0)
), lengths AS (
    SELECT DISTINCT n FROM windows
), spots AS (
    SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM said, lengths WHERE len(w) >= n)
), hits AS (
    SELECT s.doc_id, s.pos, s.n, h.item_id FROM spots s JOIN windows h ON s.n = h.n AND s.phrase = h.phrase
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
    sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM said s LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


def op8_near_matches(spark, folder):
    """The proximity half of op8, for every row of the table; the columns of op8's own query are those of its SQL."""
    documents = table(spark, folder, "documents")
    found = decontamination.near_matches(documents, table(spark, folder, "benchmark"), within=8)
    near = found.groupBy("id").agg(F.count_distinct("item").alias("n_near"), F.count_distinct("first", "second").alias("n_places"))
    joined = documents.select("doc_id").join(near, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("n_places", F.lit(0)).alias("n_places"))


#: Registered queries besides the one of each operator.
FURTHER: dict[str, Query] = {"op8_near_matches": op8_near_matches}


@query
def op4_pii_pseudonyms(spark, folder):
    found = pseudonyms.pseudonymise(table(spark, folder, "documents"), key="inkweave", found_col="found")
    kinds = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"])))
    return found.select(
        "doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join(kinds, ",").alias("kinds"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query
def op2_source_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"), weights=(5, 2, 1))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
    )


@query
def op7_posting_list_ann(spark, folder):
    found = posting_ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@query
def op9_chat_prefix_tree(spark, folder):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    found = chat_tree.conversations(rows.unionByName(extra))
    read = chat_tree.read_back(chat_tree.pack(found, tokenizer=TOKENIZER), tokenizer=TOKENIZER)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digests = read.select(
        "key", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return found.select("conv_id", "key").join(digests, "key").drop("key")


ORACLE["op9_chat_prefix_tree"] = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), written AS (
    SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length(role) + length('<|im_start|>') + length('<|im_end|>') + 2 AS chars FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


@query
def op11_embedding_whitening(spark, folder):
    found = whitening.whiten(table(spark, folder, "embeddings"), components=8)
    parts = F.posexplode(F.arrays_zip("whitened", "explained"))
    return found.select("vec_id", "n", "deviation", "identity_error", parts.alias("place", "part")).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"), "identity_error",
    )


@query
def op12_conversation_trie(spark, folder):
    numbered = conversation_trie.turns(table(spark, folder, "conversations"))
    numbered = written(numbered, "turns")
    conv = F.col("conv_id")
    length = F.crc32(conv.cast("string")) % 6
    rebuilt = conversation_trie.graft(numbered, conv - conv % 100, length, most=5)
    return conversation_trie.trie(rebuilt, numbered.where("place = 1")).drop("digest", "parent")


ORACLE["op12_conversation_trie"] = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS turns FROM said GROUP BY conv_id
), checked AS (
    SELECT conv_id, turns, conv_id - conv_id % 100 AS base, list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::UBIGINT)),
        lambda h, b: list_reduce(list_prepend(xor(h, b), list_transform(range(8), lambda i: 0::UBIGINT)),
            lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS crc
    FROM own
), long AS (
    SELECT conv_id, turns, base, CAST(xor(crc, 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM checked
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM long a LEFT JOIN own b ON b.conv_id = a.base
), paths AS (
    SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt
), members AS (
    SELECT conv_id, n, depth, turns[1:depth] AS path FROM paths
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
    FROM members GROUP BY path, depth
), valued AS (
    SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].t) END AS saved, path[1:depth - 1] AS above FROM nodes
), families AS (
    SELECT above, depth - 1 AS depth, count(*) AS n_children FROM valued WHERE depth > 0 GROUP BY above, depth
), counted AS (
    SELECT v.*, coalesce(f.n_children, 0) AS n_children FROM valued v LEFT JOIN families f ON f.above = v.path AND f.depth = v.depth
), below AS (
    SELECT path[1:k] AS path, k AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted) GROUP BY path[1:k], k
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
    CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN below b ON b.path = c.path AND b.depth = c.depth
LEFT JOIN nodes p ON p.path = c.above AND p.depth = c.depth - 1
"""


#: The rules of the query: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op13_url_cascade(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_cascade.judge(pages, url_cascade.build(rules, F.col("url"), pages))


ORACLE["op13_url_cascade"] = r"""
WITH rules(host, path, action) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), cut AS (
    SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), said AS (
    SELECT page_id, row_number() OVER () AS row, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1) AS raw, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut
), named AS (
    SELECT page_id, row, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM said
), fits AS (
    SELECT n.row, r.host || r.path AS rule, r.action,
        row_number() OVER (PARTITION BY n.row ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.action DESC) AS place
    FROM named n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM named n LEFT JOIN fits f ON f.row = n.row AND f.place = 1
"""
