"""The registered queries of this subpackage: each applies an operator to its whole table and names the columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeloom.llm import chaining, decontaminate, divergence, langid, media, neardup, packing, quality, sharding, simhash, suffix_dedup, toxicity, variants
from tapeloom.llm.common import held_out, table


def _predicted(scored: DataFrame, modulus: int, rest: int, *more: str) -> DataFrame:
    out = held_out(scored.doc_id, modulus, rest).alias("held_out")
    return scored.select("doc_id", out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(~held_out(docs.doc_id, 5, 0)), table(spark, sf_dir, "labels"))
    return _predicted(toxicity.score(docs, model), 5, 0)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page that shows its text's payload as a picture, parsed, resolved and read back."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text)
    full = F.when(size == 0, F.lit(media.WIDTH)).otherwise(F.ceil(size / media.WIDTH) * media.WIDTH)
    body = F.concat(text, F.repeat(F.lit(" "), (full - size).cast("int"))).cast("binary")
    page = F.concat(F.lit("<article><p>Document</p><figure><img src=\"digest:"), F.sha2(body, 256), F.lit("\"><figcaption>"), size.cast("string"), F.lit(" bytes of text</figcaption></figure></article>"))
    pages = docs.select("doc_id", size.cast("long").alias("n_bytes"), page.alias("html"))
    refs = media.references(media.interleaved(pages, carry=("doc_id", "n_bytes")))
    found = media.resolve(refs, media.read_back(media.store(docs)))
    return found.select("row.doc_id", "row.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages` as its ordered texts and media references."""
    pages = media.interleaved(table(spark, sf_dir, "pages"), carry=("page_id",))
    return pages.select("row.page_id", F.inline("items"))


def illustrated(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, html): every page behind a head of two pictures with captions (its address, and the document of its number, if
    there is one) and one whose payload nobody has."""
    digest = F.sha2(F.encode(media_padded(F.col("url")), "utf-8"), 256)
    own = docs.select(F.col("doc_id").alias("page_id"), F.sha2(F.encode(media_padded(F.coalesce("text", F.lit(""))), "utf-8"), 256).alias("shown"))
    x = pages.select("page_id", "html", digest.alias("address")).join(own, "page_id", "left")
    picture = lambda d: F.concat(F.lit('<img src="digest:'), d, F.lit('">'))
    number = F.col("page_id").cast("string")
    head = F.concat(F.lit("<article><h1>Page "), number, F.lit("</h1><figure><figcaption>Address of "), number, F.lit("</figcaption>"), picture(F.col("address")), F.lit("</figure><p>Lost:</p>"), picture(F.sha2(F.concat(F.lit("lost "), number), 256)))
    document = F.coalesce(F.concat(F.lit("<figure>"), picture(F.col("shown")), F.lit("<figcaption>Document "), number, F.lit("</figcaption></figure>")), F.lit(""))
    return x.select("page_id", F.concat(head, document, F.lit("</article>"), F.coalesce("html", F.lit(""))).alias("html"))


def media_padded(text: Column) -> Column:
    """A text with the blanks that fill its payload's last row."""
    size = F.octet_length(text)
    full = F.when(size == 0, F.lit(media.WIDTH)).otherwise(F.ceil(size / media.WIDTH) * media.WIDTH)
    return F.concat(text, F.repeat(F.lit(" "), (full - size).cast("int")))


def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of illustrated pages in order: texts, and media with captions and what their payloads hold, if they are known."""
    pages, docs = table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")
    items = media.interleaved(illustrated(pages, docs), carry=("page_id",)).select("row.page_id", F.inline("items"))
    known = media.read_back(media.store(pages.select(F.col("url").alias("text")).unionByName(docs.select("text"))))
    return media.resolve(items, known).select("page_id", "position", "kind", "text", "caption", "digest", "payload_bytes", "media_bytes", "media_sha256", "feature")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))[0]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), "map_version")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~held_out(docs.doc_id, 3, 1)), table(spark, sf_dir, "labels"))
    return _predicted(quality.score(docs, model), 3, 1, "n_lines", "n_bad_lines")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(docs.doc_id, 3, 1)
    model = langid.fit(docs.where(~out))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out(found.doc_id, 3, 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the language's share: the contract's columns alone, which the SQL has too."""
    return divergence.audit(table(spark, sf_dir, "documents")).drop("q")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_media_columns,
        page_items,
        page_media,
        op3_ngram_jaccard_join,
        op4_sharding,
        op5_quality_classifier,
        op6_suffix_array_dedup,
        op7_packing,
        op8_substring_dedup,
        op9_decontamination,
        op10_language_id,
        op11_source_divergence,
        op12_simhash_near_dedup,
        op13_spelling_variants,
    )
}

#: The words of a text, as the operators cut them.
_WORDS = r"""regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+')"""
_SHINGLES = f"""
    SELECT id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
    FROM (SELECT id, {_WORDS} AS w FROM src) WHERE len(w) > 0"""

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, array_to_string({_WORDS}, ' ') AS words FROM documents),
    c AS (SELECT doc_id, words, CASE WHEN words = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY words) END AS class_id FROM w),
    src AS (SELECT doc_id AS id, words AS text FROM c WHERE doc_id = class_id),
    s AS (SELECT id, len(s) AS n, unnest(s) AS s FROM ({_SHINGLES})),
    link AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id
        HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
    pair AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT a, a AS b FROM pair UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
    root AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a),
    degree AS (SELECT a, count(*) AS n_links FROM pair GROUP BY a)
SELECT c.doc_id, c.class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(group_id, c.class_id) AS group_id
FROM c LEFT JOIN root ON root.a = c.class_id LEFT JOIN degree ON degree.a = c.class_id""",
    # Two hexadecimal digits a byte: 100 bytes are 200 digits.
    "op6_suffix_array_dedup": """
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
    h AS (SELECT doc_id, [md5_number(substr(x, 2 * i + 1, 200)) FOR i IN range(0, greatest(len(x) // 2 - 99, 0))] AS hs FROM t),
    w AS (SELECT doc_id, unnest(hs) AS h, unnest(range(0, len(hs))) AS i FROM h),
    dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
    edge AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM dup),
    run AS (SELECT doc_id, i, sum(CASE WHEN last IS NULL OR i > last + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge),
    span AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM run GROUP BY doc_id, k),
    gap AS (SELECT doc_id, e AS b, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS e FROM span
        UNION ALL SELECT doc_id, 0, min(b) FROM span GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(substr(x, 2 * gap.b + 1, 2 * (coalesce(gap.e, len(x) // 2) - gap.b)), '' ORDER BY gap.b) AS k FROM gap JOIN t USING (doc_id) GROUP BY doc_id),
    n AS (SELECT doc_id, sum(e - b) AS r, count(*) AS s FROM span GROUP BY doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_decontamination": f"""
WITH d AS (SELECT id, unnest(s) AS s FROM (WITH src AS (SELECT doc_id AS id, text FROM documents) {_SHINGLES})),
    b AS (SELECT id, len(s) AS n, unnest(s) AS s FROM (WITH src AS (SELECT item_id AS id, text FROM benchmark) {_SHINGLES}))
SELECT d.id AS doc_id, b.id AS item_id, any_value(n)::INT AS item_shingles, count(*)::INT AS shared_shingles, count(*) / any_value(n) AS containment
FROM d JOIN b USING (s) GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n)""",
    "op11_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
    t AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {divergence.MIN_DOCUMENTS}),
    k AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN t USING (lang, term)),
    l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang),
    g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(k.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN k USING (lang, source) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n,
            1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 5)::HUGEINT) // (g.total + 5 * g.v)::HUGEINT AS p,
            1 + (1000000000::HUGEINT * (t.n + 5)::HUGEINT) // (l.total + 5 * l.v)::HUGEINT AS q
        FROM g JOIN l USING (lang) JOIN t USING (lang) LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= {divergence.TOP}""",
    # crc32 bit by bit; levenshtein counts bytes, so letters beyond ASCII stand for one byte each that no word has.
    "op13_spelling_variants": r"""
WITH RECURSIVE w AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
    c AS (SELECT id, w, count(*) AS n FROM w GROUP BY ALL),
    x AS (SELECT w, n, lower(hex(encode(id || ':' || w))) AS x FROM c),
    y AS (SELECT w, n, [((('0x' || substr(x, 2 * (i // 8) + 1, 2))::INT) >> (i % 8)) & 1 FOR i IN range(0, 4 * len(x))] AS bits FROM x),
    h AS (SELECT w, n, xor(list_reduce(bits, lambda crc, b: xor(crc >> 1, 3988292384 * (xor(crc, b) & 1)), 4294967295::BIGINT), 4294967295) AS h FROM y),
    d AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % len(w))::INT) || substr(w, (h % len(w))::INT + 2) ELSE w END AS word, n FROM h),
    v AS (SELECT word, sum(n)::BIGINT AS n, len(word) AS size,
            translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_`{|') AS plain
        FROM d GROUP BY word HAVING len(word) >= 6 AND sum(n) >= 5),
    near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON abs(a.size - b.size) <= 1 AND a.word <> b.word AND levenshtein(a.plain, b.plain) = 1),
    best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
    form AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 5 * v.n THEN most END AS form_n,
            CASE WHEN most >= 5 * v.n THEN (SELECT min(other) FROM near WHERE near.word = v.word AND other_n = most) END AS form
        FROM v LEFT JOIN best USING (word)),
    path AS (SELECT word, word AS at FROM form UNION ALL SELECT path.word, form.form FROM path JOIN form ON form.word = path.at WHERE form.form IS NOT NULL)
SELECT form.word, form.form, path.at AS root, form.n, form.n_near, form.form_n
FROM form JOIN path USING (word) JOIN form last ON last.word = path.at WHERE last.form IS NULL""",
}
