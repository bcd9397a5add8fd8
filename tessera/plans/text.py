"""Search, copies, ranking and similarity over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import DEPTH, INNERMOST, LONE_CLOSING, LONE_OPENING, fold_search, letter_words, mirror_preference, phrase_pattern, split_bucket, strip_marks, text_key, work_id
from tessera.operators import lexical, retrieval, similar
from tessera.operators import sequence
from tessera.operators.sequence import contained_sequences
from tessera.plans.registry import query, table
from tessera.sources.stored import remembered

TERMS = ("heha", "the", "with")
PHRASE = "of the"
_T = "SELECT doc_id AS id, unnest(regexp_extract_all(text, '\\p{L}+')) AS form FROM documents"
_TOKENS = f"tok AS (SELECT id, form, lower(form) AS normalized, count(*) AS count FROM ({_T}) GROUP BY ALL)"
_BM25 = """lens AS (SELECT id, sum(count) AS length FROM tok GROUP BY id),
    about AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
    post AS (SELECT id, normalized, sum(count) AS tf FROM tok WHERE normalized IN ({terms}) GROUP BY ALL),
    dfs AS (SELECT normalized, count(*) AS df FROM post GROUP BY 1),
    scored AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS covered
        FROM post JOIN dfs USING (normalized) JOIN lens USING (id), about GROUP BY id)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a kind and a quality: labelled 1 is source text, 0 mixed content, unlabelled needs review."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("_q"))
    quality = F.when(F.col("_q") == 1, "source_text").when(F.col("_q") == 0, "mixed_content").otherwise("needs_review")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumns({"quality": quality, "kind": F.lit("text")}).drop("_q")


_DOCS = "docs AS (SELECT d.*, CASE l.quality WHEN 1 THEN 'source_text' WHEN 0 THEN 'mixed_content' ELSE 'needs_review' END AS quality FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"""WITH {_TOKENS},
    exact AS (SELECT doc_id AS id, 0 AS priority, 0 AS matched FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])of[ \\t\\n\\r\\f]+the([^\\p{{L}}\\p{{N}}_]|$)')),
    hits AS (SELECT id, 1 AS priority, count(DISTINCT normalized) AS matched FROM tok WHERE normalized IN ('heha', 'the', 'with') GROUP BY id),
    cand AS (SELECT id, min(priority) AS priority, max(matched) AS matched FROM (SELECT * FROM exact UNION ALL SELECT * FROM hits) GROUP BY id),
    grouped AS (SELECT c.id, source, lang, priority, matched, count(*) OVER g AS copies, min(priority) OVER g AS group_priority, max(matched) OVER g AS group_matched,
        row_number() OVER (PARTITION BY lang, md5(text) ORDER BY priority, matched DESC, c.id) AS k FROM cand c JOIN documents d ON d.doc_id = c.id WINDOW g AS (PARTITION BY lang, md5(text)))
    SELECT id, source, lang, group_priority, group_matched, copies FROM grouped WHERE k = 1 ORDER BY group_priority, group_matched DESC, id LIMIT 50 OFFSET 10""")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase and term search, copies grouped, the second page; texts are looked at once and never carried through the windows."""
    docs = table(spark, sf_dir, "documents")
    tokens = text_tokens(spark, sf_dir)
    exact = docs.where(F.lower("text").rlike(phrase_pattern(PHRASE))).select(F.col("doc_id").alias("id"))
    found = lexical.term_candidates(tokens, exact, TERMS)
    narrow = docs.select(F.col("doc_id").alias("id"), "source", "lang", F.md5("text").alias("key"))
    rows = found.join(narrow, "id")
    groups = lexical.mirror_groups(rows, ["lang", "key"], [F.col("priority"), F.desc("matched"), F.col("id")], coarse=["lang", "key"])
    order = [F.col("group_priority"), F.desc("group_matched"), F.col("id")]
    return lexical.page(groups.select("id", "source", "lang", "group_priority", "group_matched", "copies"), order, 10, 50)


@query(f"WITH {_TOKENS} SELECT normalized, min(form) AS form, sum(count) AS count FROM tok GROUP BY 1")
def vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.vocabulary(text_tokens(spark, sf_dir))


@query(f"WITH {_TOKENS} SELECT normalized, sum(count) AS count FROM tok GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def vocabulary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text_tokens(spark, sf_dir)
    return tokens.groupBy("normalized").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "normalized").limit(100)


@query("""SELECT substr(sha256('["' || source || '", "' || lang || '"]'), 1, 20) AS work_id, source, lang, count(*) AS passages, sum(n_chars) AS characters, min(doc_id) AS first_id FROM documents GROUP BY source, lang""")
def works_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("passages"), F.sum("n_chars").alias("characters"), F.min("doc_id").alias("first_id"))
    return docs.withColumn("work_id", work_id(F.col("source"), F.col("lang")))


@query("SELECT doc_id, source, row_number() OVER w - 1 AS sequence, lag(doc_id) OVER w AS previous_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)")
def passage_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    placed = lexical.with_sequence(rows, ["source", "lang"], ["doc_id"])
    return lexical.neighbours(placed, ["source", "lang"], ["doc_id"], "doc_id").select("doc_id", "source", F.col("sequence").cast("long").alias("sequence"), "previous_id", "next_id")


@query(f"""WITH {_DOCS} SELECT lang, source, quality, grouping(lang) * 4 + grouping(source) * 2 + grouping(quality) AS level, count(*) AS passages, count(DISTINCT md5(text)) AS texts
    FROM docs GROUP BY GROUPING SETS ((lang), (source), (quality), ())""")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("lang", "source", "quality", F.md5("text").alias("key"))
    sets = rows.groupingSets([[F.col("lang")], [F.col("source")], [F.col("quality")], []], "lang", "source", "quality")
    return sets.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("passages"), F.countDistinct("key").alias("texts"))


@query(f"WITH {_DOCS} SELECT source, lang, count(*) AS total, count_if(quality = 'source_text') AS n_source_text, count_if(quality = 'mixed_content') AS n_mixed_content, count_if(quality = 'needs_review') AS n_needs_review FROM docs GROUP BY 1, 2")
def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.audit import coverage

    return coverage(documents(spark, sf_dir), ["source", "lang"], "quality", ["source_text", "mixed_content", "needs_review"])


@query("""WITH k AS (SELECT doc_id, source, sha1(concat_ws(chr(31), lang, 'text', trim(regexp_replace(nfc_normalize(text), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')))) AS key FROM documents)
    SELECT id, text_key, copies, mirrored_ids FROM (SELECT doc_id AS id, substr(key, 1, 24) AS text_key, count(*) OVER g AS copies, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k,
        array_to_string(list_filter(list_sort(list(doc_id) OVER g), lambda x: x <> doc_id), ',') AS mirrored_ids FROM k WINDOW g AS (PARTITION BY key)) WHERE k = 1""")
def mirror_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text_key(F.col("lang"), F.lit("text"), F.col("text")).alias("text_key"))
    return lexical.mirror_groups(rows, ["text_key"], [F.col("id")])


@query(f"""WITH {_DOCS}, r AS (SELECT doc_id AS id, md5(text) AS key, quality, CASE quality WHEN 'source_text' THEN 0 ELSE 3 END * 10 + CASE source WHEN 'src1' THEN 2 WHEN 'src2' THEN 3 ELSE 0 END AS pref, doc_id % 2 AS priority, n_chars % 5 AS matched FROM docs)
    SELECT id, quality, pref, copies, group_priority, group_matched FROM (SELECT *, count(*) OVER (PARTITION BY key, quality) AS copies, row_number() OVER (PARTITION BY key, quality ORDER BY priority, pref, matched DESC, id) AS k,
        min(priority) OVER (PARTITION BY key) AS group_priority, max(matched) OVER (PARTITION BY key) AS group_matched FROM r) WHERE k = 1""")
def mirror_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representatives by text and quality, ranks by text alone."""
    pref = mirror_preference(F.col("quality"), F.col("source"), {"src1": 2, "src2": 3})
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.md5("text").alias("key"), "quality", pref.alias("pref"), (F.col("doc_id") % 2).alias("priority"), (F.col("n_chars") % 5).alias("matched"))
    out = lexical.mirror_groups(rows, ["key", "quality"], [F.col("priority"), F.col("pref"), F.desc("matched"), F.col("id")], coarse=["key"])
    return out.select("id", "quality", "pref", "copies", "group_priority", "group_matched")


@query(f"WITH {_TOKENS}, {_BM25.format(terms="'heha', 'the', 'with'")} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(text_tokens(spark, sf_dir), TERMS).select("id", "score").orderBy(F.desc("score"), "id").limit(50)


@query(f"WITH {_TOKENS}, {_BM25.format(terms="'heha', 'the', 'with'")} SELECT id, score, covered FROM scored ORDER BY covered DESC, score DESC, id LIMIT 50")
def bm25_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(text_tokens(spark, sf_dir), TERMS).orderBy(F.desc("covered"), F.desc("score"), "id").limit(50)


@query(f"""WITH {_TOKENS}, own AS (SELECT DISTINCT normalized FROM tok WHERE id IN (1, 2, 3, 4, 5) AND length(normalized) >= 4)
    SELECT normalized, sum(count) AS count FROM tok JOIN own USING (normalized) GROUP BY 1 HAVING sum(count) > 1 AND sum(count) <= 400 ORDER BY 2, 1 LIMIT 30""")
def prf_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.feedback_terms(text_tokens(spark, sf_dir), [1, 2, 3, 4, 5])


@query(f"""WITH {_TOKENS}, t(gid, key) AS (VALUES (1, 'the'), (1, 'la'), (2, 'of'), (2, 'de'), (3, 'with'), (3, 'que'))
    SELECT id, count(DISTINCT gid) AS groups FROM tok JOIN t ON normalized = key GROUP BY id HAVING count(DISTINCT gid) = 3""")
def all_terms_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame([(1, "the"), (1, "la"), (2, "of"), (2, "de"), (3, "with"), (3, "que")], "gid int, key string")
    return lexical.all_groups_present(text_tokens(spark, sf_dir), groups)


@query("SELECT quality, lang, count(*) AS hidden FROM (SELECT d.lang, CASE l.quality WHEN 1 THEN 'source_text' WHEN 0 THEN 'mixed_content' ELSE 'needs_review' END AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE contains(lower(text), 'of the')) WHERE quality <> 'source_text' GROUP BY 1, 2")
def excluded_exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the default quality gate hides of a literal search."""
    rows = documents(spark, sf_dir).where(F.lower("text").contains(PHRASE)).where("quality != 'source_text'")
    return rows.groupBy("quality", "lang").agg(F.count(F.lit(1)).alias("hidden"))


@query("SELECT doc_id, md5(translate(strip_accents(lower(text)), 'ςϲϹ’᾽ʼ', 'σσσ''''''')) AS folded FROM documents")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fold_search(F.col("text"))).alias("folded"))


@query("""SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])of[ \\t\\n\\r\\f]+the([^\\p{L}\\p{N}_]|$)') AS exact FROM documents""")
def phrase_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower("text").rlike(phrase_pattern(PHRASE)).alias("exact"))


@query("""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '\\p{L}+') AS t FROM documents), p AS (SELECT id, t, unnest(range(1, len(t))) AS i FROM w)
    SELECT DISTINCT id FROM p WHERE t[i] = 'of' AND t[i + 1] = 'the'""")
def phrase_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent words in order, by positions."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), letter_words(F.lower("text")).alias("t"))
    return words.where(F.exists(F.arrays_zip(F.col("t").alias("a"), F.slice("t", 2, 1 << 30).alias("b")), lambda p: (p["a"] == "of") & (p["b"] == "the"))).select("id")


@query("""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '\\p{L}+') AS t FROM documents), p AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM w),
    a AS (SELECT id, i FROM p WHERE t[i] = 'with'), b AS (SELECT id, i FROM p WHERE t[i] = 'this') SELECT a.id, min(abs(a.i - b.i)) AS distance FROM a JOIN b ON a.id = b.id AND abs(a.i - b.i) <= 3 GROUP BY a.id""")
def phrase_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words near each other, in either order: only the places of the two words are joined."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(letter_words(F.lower("text"))).alias("i", "w")).where("w in ('with', 'this')")
    one, two = words.where("w = 'with'").select("id", F.col("i").alias("a")), words.where("w = 'this'").select("id", F.col("i").alias("b"))
    return one.join(two, "id").where("abs(a - b) <= 3").groupBy("id").agg(F.min(F.abs(F.col("a") - F.col("b"))).cast("long").alias("distance"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, form, normalized, count) of all documents: stored once for each version of the table.

    Rows stay where they were counted, dealt by text and form, so one shuffle makes
    the table; each file is in order of terms, so a search reads few pages of it.
    """
    build = lambda docs: lexical.token_table(docs).sortWithinPartitions("normalized", "id")
    return remembered(table(spark, sf_dir, "documents"), "tokens", build)


def text_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positional index of all documents, stored once for each version of the table."""
    return remembered(table(spark, sf_dir, "documents"), "positions", sequence.positional_index)


_BARE = sequence.BARRIER.replace("'", "''")


def _readable_sql(text: str) -> str:
    """``readable`` in SQL."""
    for _ in range(DEPTH):
        text = f"regexp_replace({text}, '{INNERMOST}', '…', 'g')"
    return f"regexp_replace(regexp_replace({text}, '{LONE_CLOSING}', '…', 'g'), '{LONE_OPENING}', '…', 'g')"


_PLACES = f"""pieces AS (SELECT id, unnest(s) AS piece, unnest(range(len(s))) AS segment FROM (SELECT doc_id AS id, string_split_regex({_readable_sql("text")}, '{_BARE}') AS s FROM documents)),
    occ AS (SELECT id, segment, unnest(w) AS form, unnest(range(len(w))) AS place FROM (SELECT id, segment, regexp_extract_all(piece, '\\p{{L}}+') AS w FROM pieces))"""
ORDERED, SLOP = [{"of", "de"}, {"the", "la"}, {"with", "pour", "of"}], 2
REPEATED = [{"with"}, {"with"}, {"this", "with", "de"}]


@query(f"""WITH {_PLACES}, m AS (SELECT *, lower(form) AS t FROM occ),
    hits AS (SELECT a.id, a.segment, a.place AS first, b.place AS middle, c.place AS last, a.form || ' ' || b.form || ' ' || c.form AS forms FROM m a JOIN m b ON b.id = a.id AND b.segment = a.segment AND b.place > a.place AND b.place <= a.place + 4
        JOIN m c ON c.id = a.id AND c.segment = a.segment AND c.place > b.place AND c.place <= a.place + 4 WHERE a.t IN ('of', 'de') AND b.t IN ('the', 'la') AND c.t IN ('with', 'pour', 'of'))
    SELECT id, segment, first, last, last - first - 2 AS extra_words, forms FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY segment, first, middle, last) AS k FROM hits) WHERE k = 1""")
def sequence_ordered_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in order with up to two others between them; brackets and gaps part them."""
    return sequence.in_order(text_positions(spark, sf_dir), ORDERED, SLOP)


@query(f"""WITH {_PLACES}, m AS (SELECT id, segment, place, form, CASE lower(form) WHEN 'with' THEN 3 ELSE 2 END AS mask FROM occ WHERE lower(form) IN ('with', 'this', 'de')),
    w AS (SELECT *, count_if(mask = 3) OVER r AS a, count(*) OVER r AS b FROM m WINDOW r AS (PARTITION BY id, segment ORDER BY place RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING)),
    f AS (SELECT id, segment, place AS first FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY segment, place) AS k FROM w WHERE a >= 2 AND b >= 3) WHERE k = 1),
    i AS (SELECT m.*, first, count_if(mask = 3) OVER s >= 2 AND count(*) OVER s >= 3 AS ok FROM m JOIN f ON m.id = f.id AND m.segment = f.segment AND place BETWEEN first AND first + 11 WINDOW s AS (PARTITION BY m.id ORDER BY place ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT id, min(place) AS last FROM i WHERE ok GROUP BY id)
    SELECT i.id, segment, first, last, last - first - 2 AS extra_words, string_agg(form, ' ' ORDER BY place) AS forms FROM i JOIN l ON i.id = l.id AND place <= last GROUP BY i.id, segment, first, last""")
def sequence_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words in any order among twelve; one is asked for twice, and fits the third as well."""
    return sequence.near_each_other(text_positions(spark, sf_dir), REPEATED, 9)


@query(f"""WITH {_PLACES} SELECT id, count(*) AS tokens FROM occ WHERE lower(form) IN ('with', 'this', 'de') GROUP BY id HAVING count_if(lower(form) = 'with') >= 2 AND count(*) >= 3""")
def sequence_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.all_words(text_positions(spark, sf_dir), REPEATED)


@query("""WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '\\p{L}+') AS t FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '\\p{L}+'), ' ') || ' ' AS s FROM documents)
    SELECT item_id, doc_id FROM q, d WHERE len(t) >= 2 AND contains(s, ' ' || array_to_string(t, ' ') || ' ')""")
def quoted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that stand in documents, word for word."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), letter_words(F.lower("text")).alias("tokens"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), letter_words(F.lower("text")).alias("tokens"))
    return contained_sequences(quotes, texts).select(F.col("quote_id").alias("item_id"), F.col("id").alias("doc_id")).distinct()


@query("""WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '\\p{L}+') AS t FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '\\p{L}+'), ' ') || ' ' AS s, n_chars FROM documents),
    m AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars, doc_id) AS position, doc_id % 3 = 0 AS target FROM q, d WHERE len(t) >= 2 AND contains(s, ' ' || array_to_string(t, ' ') || ' ')),
    r AS (SELECT item_id, min(position) FILTER (WHERE target AND position <= 10) AS rank FROM m GROUP BY 1)
    SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_10,
        round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 4) AS mrr_10 FROM r""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of judged documents (every third identifier) among those that quote a benchmark passage, shortest first."""
    hits = quoted_passages(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    results = hits.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy("item_id").orderBy("n_chars", "doc_id")).alias("position"))
    credit = hits.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("credit_key"), (F.col("doc_id") % 3 == 0).alias("is_target"))
    ranks = results.select("query_id").distinct().join(retrieval.rank_of_target(results, credit), "query_id", "left")
    return retrieval.recall_and_mrr(ranks)


_WORDS = "ask AS (SELECT DISTINCT replace(strip_accents(lower(w)), 'ß', 'ss') AS word FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM benchmark))"


def _spelling(word: Column) -> Column:
    """Spellings without marks, so that characters and bytes are the same."""
    return F.replace(strip_marks(word), F.lit("ß"), F.lit("ss"))


def _benchmark_words(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(letter_words(F.col("text"))).alias("w"))
    return words.where(which).select(_spelling(F.col("w")).alias("word")).distinct()


@query(f"""WITH {_TOKENS}, voc AS (SELECT DISTINCT replace(strip_accents(normalized), 'ß', 'ss') AS normalized FROM tok), {_WORDS},
    vg AS (SELECT DISTINCT normalized, gram FROM (SELECT normalized, substr('^' || normalized || '$', unnest(range(1, length(normalized) + 1)), 3) AS gram FROM voc)),
    ag AS (SELECT DISTINCT word, gram FROM (SELECT word, substr('^' || word || '$', unnest(range(1, length(word) + 1)), 3) AS gram FROM ask)),
    sizes AS (SELECT gram, count(*) AS postings FROM vg GROUP BY 1),
    rare AS (SELECT word, gram FROM (SELECT word, gram, row_number() OVER (PARTITION BY word ORDER BY postings, gram) AS k FROM ag JOIN sizes USING (gram)) WHERE k <= 5),
    pool AS (SELECT DISTINCT word, normalized FROM rare JOIN vg USING (gram) WHERE length(word) >= 5 UNION SELECT word, normalized FROM ask JOIN voc ON word[1] = normalized[1] AND abs(length(word) - length(normalized)) <= CASE WHEN length(word) < 6 THEN 1 ELSE 2 END WHERE length(word) < 5 OR (length(word) <= 6 AND length(normalized) < 5)),
    near AS (SELECT word, normalized, levenshtein(word, normalized) AS distance FROM pool)
    SELECT word, normalized, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, normalized) AS k FROM near WHERE distance <= CASE WHEN length(word) < 6 THEN 1 ELSE 2 END) WHERE k <= 80""")
def levenshtein_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = text_tokens(spark, sf_dir).select("normalized").distinct()
    vocabulary = vocabulary.select(_spelling(F.col("normalized")).alias("normalized")).distinct()
    return similar.near_keys(vocabulary, _benchmark_words(spark, sf_dir))


@query()
def difflib_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close spellings by matching blocks: what no SQL function computes."""
    vocabulary = text_tokens(spark, sf_dir).select("normalized").distinct()
    return similar.close_matches(vocabulary, _benchmark_words(spark, sf_dir))


@query()
def shingle_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-identical texts of at least 80 characters, each known by the smallest document that has it: shingles, lengths and then matching blocks, which SQL doesn't have."""
    texts = table(spark, sf_dir, "documents").where("length(text) >= 80")
    return similar.near_duplicate_texts(texts.groupBy("text").agg(F.min("doc_id").alias("id")).select("id", "text"))


@query("SELECT doc_id AS id, min(doc_id) OVER w AS class_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text)")
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest document of the same text: what the pairs of near-identical texts stand for."""
    return similar.text_classes(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, CAST(('0x' || substr(sha1(doc_id::VARCHAR), 33, 8))::BIGINT AS BIGINT) AS low, CASE WHEN b < 10 THEN 'dev' ELSE 'train' END AS split, b AS bucket FROM (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, [('0x' || c)::BIGINT FOR c IN string_split(sha1(doc_id::VARCHAR), '')]), lambda a, d: (a * 16 + d) % 100) AS b FROM documents)")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable split: the whole SHA-1 of the identifier modulo 100."""
    key = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.conv(F.substring(F.sha1(key.cast("binary")), 33, 8), 16, 10).cast("long").alias("low"), split_bucket(key).cast("long").alias("bucket"))
    return rows.withColumn("split", F.when(F.col("bucket") < 10, "dev").otherwise("train"))


@query("""WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) AS turn FROM documents)
    SELECT doc_id, source, turn FROM t WHERE turn <= 33 ORDER BY turn, source LIMIT 100""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 100).select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


@query("""WITH w AS (SELECT source || '/' || lang AS work, count(*) AS size FROM documents GROUP BY 1), t AS (SELECT sum(size) AS total FROM w), s AS (SELECT w.*, total FROM w, t WHERE size <= total * 0.05),
    o AS (SELECT work, size, total, coalesce(sum(size) OVER (ORDER BY md5(work), work ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT work, size, before FROM o WHERE before < total * 0.1""")
def held_out_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("work")).agg(F.count(F.lit(1)).alias("size"))
    return retrieval.held_out_works(works, "work", "size", 0.1, 0.05)


@query(f"""WITH {_TOKENS}, {_BM25.format(terms="'heha', 'the', 'with'")}, me AS (SELECT source AS mine FROM documents WHERE doc_id = 1),
    c AS (SELECT id, score, source = mine AS same, covered / 3.0 AS overlap FROM scored JOIN documents ON doc_id = id, me) SELECT id, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM c WHERE NOT same AND overlap < 0.5) WHERE rank <= 20""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mine = docs.where("doc_id = 1").select(F.col("source").alias("mine"))
    scored = lexical.bm25(text_tokens(spark, sf_dir), TERMS)
    candidates = scored.join(docs.select(F.col("doc_id").alias("id"), "source"), "id").crossJoin(F.broadcast(mine))
    candidates = candidates.select(F.lit(1).alias("query_id"), "id", "score", (F.col("source") == F.col("mine")).alias("same_work"), (F.col("covered") / 3.0).alias("overlap"))
    return retrieval.hard_negatives(candidates, 20).select("id", "score", F.col("rank").cast("long").alias("rank"))
