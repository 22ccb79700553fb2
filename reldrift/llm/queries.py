"""The registered queries of this package, over whole tables, and their DuckDB statements."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, divergence, fingerprint, hpylm, licenses, merkle, oddsketch, pii, repeats, secret_scan, toxicity
from .common import fold, table

PROBE = "<|im_end|><|im_start|>assistant ok"


def op6_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations and one of control strings, read back from their formatted text."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string"
    )
    done = chat.format_conversations(rows.unionByName(probe)).withColumn("_back", chat.read_back(F.col("formatted")))
    per_turn = F.transform("_back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = chat.under_loss(F.col("formatted"), F.col("loss_mask"))
    return done.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(per_turn, ""), 256).alias("turns_sha256"),
        F.length(F.array_join(masked, "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(masked, ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("messages").cast("long").alias("n_messages"),
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w IS DISTINCT FROM role AS starts,
         lead(role) OVER w IS DISTINCT FROM role AS ends
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
            + (length(text) - length(replace(text, '<|', ''))) // 2 AS text_chars,
         length(role) + length(role) - length(replace(role, '\', ''))
            + (length(role) - length(replace(role, '<|', ''))) // 2
            + length(role) - length(replace(role, chr(10), '')) AS role_chars
  FROM placed
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(text_chars + CASE WHEN starts THEN role_chars + 13 ELSE 9 END
           + CASE WHEN ends THEN 11 ELSE 0 END) AS BIGINT) AS formatted_chars,
       count(*) FILTER (starts) AS n_messages
FROM sized GROUP BY conv_id
"""


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs).select("doc_id", "token_ids")
    return bpe.decode(encoded).select(
        "doc_id",
        bpe.token_count().alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_hpy_lm(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a model that learns from six sevenths of the documents; the rest is held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = hpylm.score(docs, hpylm.train(docs.where(fold(7) != 2)))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select(
        "doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity.alias("perplexity")
    )


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document: strong spans, and weak parts whose complement stands in their scope.

    A NULL text has none; repeated rows get equal spans.
    """
    return secret_scan.report(secret_scan.scan(table(spark, sf, "documents").select("doc_id", "text")))


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a classifier that has seen no label of the fold it is judged on."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "toxic").where(fold(5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", "score")
    return scored.select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op9_pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document: base spans, and candidates the boosted trees accept.

    A NULL text has none; repeated rows get equal spans.
    """
    return pii.report(pii.scan(table(spark, sf, "documents").select("doc_id", "text")))


def op10_odd_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of near copies; a NULL or empty text is alone, a row without an id has no group."""
    return oddsketch.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


def op7_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every text and its edited text; rows of one id follow each other by text."""
    return fingerprint.edited_fingerprints(table(spark, sf, "documents").select("doc_id", "text"))


def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without the strings it shares with earlier ones."""
    cut = repeats.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_spaced_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark text, with the words they share."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return decontam.find_leaks(docs, items).drop("_row")


def op13_source_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Distances between the sources of a language, and the terms each uses more than its language."""
    return divergence.Audit(table(spark, sf, "documents")).report()


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), found AS (
  SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n_lang FROM found GROUP BY ALL HAVING count(DISTINCT r) >= 30
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n_lang)::HUGEINT AS total_lang FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(v, 0)::HUGEINT AS v, coalesce(total_lang, 0)::HUGEINT AS total_lang, coalesce(total, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
         1 + (1000000000::HUGEINT * (k.n_lang + 5)) // (g.total_lang + 5 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM dense WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Digest and proof of every document; even folds present a text without its line feeds."""
    docs = table(spark, sf, "documents")
    fields = lambda text: [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    leaf = merkle.leaf_digest(fields(F.col("text")))
    tampered = merkle.leaf_digest(fields(F.replace("text", F.lit("\n"), F.lit(""))))
    manifest = merkle.build(docs, "source", "doc_id", leaf, F.when(fold(2) == 0, tampered).otherwise(leaf))
    return merkle.verified(spark, manifest).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


_CRC32 = """xor(list_reduce(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, c: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, c)),
    4294967295), 4294967295)"""


def _merkle_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"


# nodes ascend by level; `up` holds the siblings of a leaf level by level, `tree` is a source and then the tree of subroots
OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_merkle_leaf('text')} AS leaf,
    CASE WHEN {_CRC32} & 1 = 0 THEN {_merkle_leaf("replace(text, chr(10), '')")} ELSE {_merkle_leaf('text')} END AS claimed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), low AS (
  SELECT 0 AS level, tree, place, leaf AS digest FROM placed
  UNION ALL
  SELECT any_value(level) + 1, tree, place // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM low WHERE tree IN (SELECT tree FROM low GROUP BY tree HAVING count(*) > 1) GROUP BY tree, place // 3
), subroots AS (
  SELECT tree, digest, level FROM (SELECT *, max(level) OVER (PARTITION BY tree) AS top FROM low) WHERE level = top
), high AS (
  SELECT 0 AS level, tree - 1 AS place, digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM high WHERE (SELECT count(*) FROM high) > 1 GROUP BY place // 3
), steps AS (
  SELECT n.tree, n.level, n.place, coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place < n.place), '') AS lefts,
    coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (s.place > n.place), '') AS rights
  FROM (SELECT *, 0 AS upper FROM low UNION ALL SELECT level, 0, place, digest, 1 FROM high) n
  JOIN (SELECT *, 0 AS upper FROM low UNION ALL SELECT level, 0, place, digest, 1 FROM high) s
    ON n.upper = s.upper AND n.tree = s.tree AND n.level = s.level AND n.place // 3 = s.place // 3
  WHERE n.level < CASE WHEN n.upper = 0 THEN (SELECT b.level FROM subroots b WHERE b.tree = n.tree) ELSE (SELECT max(level) FROM high) END
  GROUP BY n.tree, n.upper, n.level, n.place
), walk AS (
  SELECT p.id, p.doc_id, p.leaf, p.tree AS own, p.tree, p.place, 0 AS level, b.level AS height, p.claimed AS folded, '' AS siblings
  FROM placed p JOIN subroots b ON p.tree = b.tree
  UNION ALL
  SELECT w.id, w.doc_id, w.leaf, w.own,
    CASE WHEN w.level = w.height THEN 0 ELSE w.tree END,
    CASE WHEN w.level = w.height THEN w.own - 1 ELSE w.place // 3 END,
    CASE WHEN w.level = w.height THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.level = w.height THEN (SELECT max(level) FROM high) ELSE w.height END,
    CASE WHEN w.level = w.height THEN w.folded ELSE sha256(s.lefts || w.folded || s.rights) END,
    CASE WHEN w.level = w.height THEN w.siblings ELSE w.siblings || s.lefts || s.rights END
  FROM walk w LEFT JOIN steps s ON s.tree = w.tree AND s.level = w.level AND s.place = w.place
  WHERE w.tree > 0 OR w.level < w.height
), ends AS (
  SELECT * FROM walk WHERE tree = 0 AND level = height
)
SELECT e.doc_id, e.leaf, b.digest AS subroot, r.digest AS root, sha256(e.siblings) AS proof_sha256, e.folded AS folded_root,
  e.folded = r.digest AS verified
FROM ends e JOIN subroots b ON e.own = b.tree, (SELECT digest FROM high ORDER BY level DESC LIMIT 1) r
"""


def op12_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Places of license phrases, and the licenses whose notices stand in a text."""
    return licenses.report(licenses.scan(table(spark, sf, "documents"))).drop("row")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(
    f"({i}, {_quoted(text)}, {_quoted(label)}, {i < len(licenses.PHRASES)})"
    for i, (text, label) in enumerate([*licenses.PHRASES, *licenses.NOTICES])
)

OP12_SQL = rf"""
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), templates AS (
  SELECT t, label, base, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM (VALUES {_TEMPLATES}) v(t, body, label, base)
), sized AS (
  SELECT *, len(w) AS size, least(3, len(w)) AS k, CASE WHEN base THEN 0 ELSE least(8, len(w) // 4) END AS slack FROM templates
), template_grams AS (
  SELECT t, label, base, size, k, slack, place, array_to_string(w[place + 1 : place + k], ' ') AS gram
  FROM sized, unnest(range(size - k + 1)) p(place)
), document_grams AS (
  SELECT r, spot, k, array_to_string(w[spot + 1 : spot + k], ' ') AS gram
  FROM low, unnest(range(len(w))) p(spot), (VALUES (2), (3)) ks(k)
), hits AS (
  SELECT r, spot, t, label, base, size, k, slack, place, spot - place AS diagonal
  FROM document_grams JOIN template_grams USING (k, gram)
), bands AS (
  SELECT *, sum(apart) OVER (PARTITION BY r, t ORDER BY diagonal, spot ROWS UNBOUNDED PRECEDING) AS band FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal, spot) > slack THEN 1 ELSE 0 END AS apart FROM hits)
), shares AS (
  SELECT r, t, band, label, base, size, min(spot) AS first_at, max(spot + k) AS end_at, count(DISTINCT word) AS n
  FROM (SELECT *, unnest(range(place, place + k)) AS word FROM bands) GROUP BY ALL
), spans AS (
  SELECT *, n / size AS share FROM shares
  WHERE CASE WHEN base THEN n = size ELSE n / size >= {licenses.SHARE} AND end_at - first_at <= {licenses.STRETCH} * size END
)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base,
  CAST(min(first_at) FILTER (base) AS BIGINT) AS first_word, CAST(max(first_at) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
FROM low LEFT JOIN spans USING (r) GROUP BY r
"""


QUERIES = {
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_license_scan": op12_license_scan,
    "op13_source_audit": op13_source_audit,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op1_hpy_lm": op1_hpy_lm,
    "op5_spaced_seeds": op5_spaced_seeds,
    "op7_fingerprint": op7_fingerprint,
    "op10_odd_sketch": op10_odd_sketch,
    "op2_secret_scan": op2_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op9_pii_spans": op9_pii_spans,
    "op6_chat_format": op6_chat_format,
    "op8_byte_bpe": op8_byte_bpe,
}

ORACLE = {"op6_chat_format": OP6_SQL, "op11_merkle_manifest": OP11_SQL, "op12_license_scan": OP12_SQL, "op13_source_audit": OP13_SQL}
