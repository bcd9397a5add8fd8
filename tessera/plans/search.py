"""Scoped fusion, expansion of query words, and alignments across texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import letter_words, lowered, without_marks
from tessera.operators import alignment, audit, expansion, fusion, inflection, lexical, nested, references, search
from tessera.plans.registry import query, table
from tessera.plans.text import _TOKENS, _BM25, _spelling, text_tokens
from tessera.sources.stored import materialized, remembered

_ROLE = {"user": ("text", "grc", "a", 5), "assistant": ("translation", "eng", "m", 2)}
AUTHORS = ("a1", "a2")


def turn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as records: questions are source texts, answers hang on the question before them."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumns({
        "kind": F.when(user, "text").when(answer, "translation").otherwise("reference"), "language": F.when(user, "grc").when(answer, "eng").otherwise("lat"), "edition": F.concat(F.lit("e"), F.col("conv_id") % 3),
        "author": F.when(user, F.concat(F.lit("a"), F.col("conv_id") % 5)).otherwise(F.concat(F.lit("m"), F.col("conv_id") % 2)), "quality": F.when(F.length("text") % 7 == 0, "needs_review").otherwise("source_text"),
        "parent_id": F.max(F.when(user, F.col("id"))).over(before),
    })
    group = F.md5(F.concat_ws("|", "author", "language", "kind", "quality", "text"))
    return rows.select("id", "parent_id", F.array("author").alias("author_keys"), "language", "edition", "kind", "quality", F.md5(F.lower("text")).alias("copy_key"), group.alias("group_key"), "text")


def _hit_lists(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    """Three lists of at most 400 turns."""
    tokens = remembered(table(spark, sf_dir, "conversations"), "turn_tokens", lambda _: lexical.token_table(records, "id"))
    scored = lexical.bm25(tokens, ["the", "of"]).select("id", "score")
    counted = tokens.where("normalized in ('with', 'this')").groupBy("id").agg(F.sum("count").alias("score"))
    long = records.select("id", F.length("text").alias("score"))
    lists = [
        rows.orderBy(F.desc("score"), "id").limit(400).select(F.lit(name).alias("signal"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("position"), "id")
        for name, rows in (("lexical", scored), ("forms", counted), ("semantic", long))
    ]
    return lists[0].union(lists[1]).union(lists[2])


def _fused(spark: SparkSession, sf_dir: str, scope: fusion.Scope) -> DataFrame:
    records = turn_records(spark, sf_dir)
    found = fusion.fuse(_hit_lists(spark, sf_dir, records), records, scope, {"lexical": 2.0})
    told = found.orderBy(F.desc("score"), "best_rank", "id").limit(50)
    pairs = F.array_join(F.transform(F.map_entries("ranks"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["signal"], e["id"], e["scope"])), ",")
    return told.select("id", "score", F.col("best_rank").cast("long").alias("best_rank"), pairs.alias("ranks"), evidence.alias("evidence"), F.array_join("copies", ",").alias("copies"), "reason")


def _fused_sql(language: str) -> str:
    fits = f"AND language = '{language}'" if language else ""
    good = "kind NOT IN ('reference', 'apparatus') AND quality <> 'needs_review'"
    return f"""WITH turns AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text FROM conversations),
    rec AS (SELECT id, text, CASE role WHEN 'user' THEN 'text' WHEN 'assistant' THEN 'translation' ELSE 'reference' END AS kind, CASE role WHEN 'user' THEN 'grc' WHEN 'assistant' THEN 'eng' ELSE 'lat' END AS language,
        CASE role WHEN 'user' THEN 'a' || conv_id % 5 ELSE 'm' || conv_id % 2 END AS author, CASE WHEN length(text) % 7 = 0 THEN 'needs_review' ELSE 'source_text' END AS quality,
        max(CASE WHEN role = 'user' THEN id END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_id, md5(lower(text)) AS copy_key FROM turns),
    facts AS (SELECT *, md5(concat_ws('|', author, language, kind, quality, text)) AS gk, author IN ('a1', 'a2') AND {good} {fits} AS ok, {good} {fits} AS whoever,
        kind = 'text' AND language = 'grc' AND author IN ('a1', 'a2') AND {good} {fits} AS okp, kind = 'text' AND language = 'grc' AND author IN ('a1', 'a2') AND {good} AS oka FROM rec),
    tok AS (SELECT id, form, lower(form) AS normalized, count(*) AS count FROM (SELECT id, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS form FROM turns) GROUP BY ALL),
    {_BM25.format(terms="'the', 'of'")},
    pools AS (SELECT 'lexical' AS signal, 1 AS list, id, score FROM scored UNION ALL SELECT 'forms', 2, id, sum(count) FROM tok WHERE normalized IN ('with', 'this') GROUP BY id UNION ALL SELECT 'semantic', 3, id, length(text) FROM turns),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY score DESC, id) AS position FROM pools) WHERE position <= 400),
    copies AS (SELECT copy_key, min(id) AS cid, arg_min(gk, id) AS cgk FROM facts WHERE ok GROUP BY 1),
    met AS (SELECT signal, list, position, r.id, r.kind = 'translation' AND coalesce(p.okp, false) AS up, r.ok OR (r.kind = 'translation' AND r.whoever AND coalesce(p.oka, false)) AS own, r.ok AS ok, p.id AS pid, p.gk AS pgk, r.gk AS rgk, cid, cgk
        FROM hits h JOIN facts r ON r.id = h.id LEFT JOIN facts p ON p.id = r.parent_id LEFT JOIN copies c ON c.copy_key = r.copy_key WHERE r.quality <> 'needs_review'),
    t AS (SELECT signal, list, position, id, CASE WHEN up THEN pid WHEN own THEN id ELSE cid END AS target, CASE WHEN up THEN pgk WHEN own THEN rgk ELSE cgk END AS gk, CASE WHEN up THEN 'explicit_parent' WHEN ok THEN 'direct' WHEN own THEN 'author_of_parent' ELSE 'copy_in_scope' END AS scope FROM met),
    u AS (SELECT * FROM t WHERE target IS NOT NULL),
    v AS (SELECT signal, gk, row_number() OVER (PARTITION BY signal ORDER BY min(position)) AS rank FROM u GROUP BY signal, gk),
    s AS (SELECT gk, round(sum(CASE signal WHEN 'lexical' THEN 2.0 ELSE 1.0 END / (60 + rank)), 8) AS score, min(rank) AS best_rank, string_agg(signal || ':' || rank, ',' ORDER BY signal) AS ranks, string_agg(signal, ' + ' ORDER BY signal) AS names FROM v GROUP BY gk),
    e AS (SELECT gk, string_agg(signal || ':' || id || ':' || scope, ',' ORDER BY signal, id, scope) AS evidence FROM (SELECT DISTINCT gk, signal, id, scope FROM u) GROUP BY gk),
    g AS (SELECT gk, string_agg(target, ',' ORDER BY target) AS copies FROM (SELECT DISTINCT gk, target FROM u) GROUP BY gk),
    f AS (SELECT gk, arg_min(target, list * 100000 + position) AS id FROM u GROUP BY gk), b AS (SELECT u.gk, bool_or(u.id <> f.id) AS bridged FROM u JOIN f USING (gk) GROUP BY u.gk)
    SELECT id, score, best_rank, ranks, evidence, copies, names || CASE WHEN bridged THEN '; linked evidence' ELSE '; direct match' END AS reason FROM s JOIN e USING (gk) JOIN g USING (gk) JOIN f USING (gk) JOIN b USING (gk) ORDER BY score DESC, best_rank, id LIMIT 50"""


@query(_fused_sql(""))
def fused_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of two authors, found by themselves, by their answers or by copies of their words."""
    return _fused(spark, sf_dir, fusion.Scope(authors=AUTHORS))


@query(_fused_sql("eng"))
def fused_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers only, of whatever author, that belong to questions of two authors."""
    return _fused(spark, sf_dir, fusion.Scope(authors=AUTHORS, language="eng"))


WORDS = ("the", "an", "at", "st")
_SUFFIX, _PREFIX = "(tion|ing|ed|er)$", "^(un|re|in)"


def lexicon(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A lexicon drawn from the tables: forms of stems, headwords, listed forms, equal spellings."""
    vocabulary = text_tokens(spark, sf_dir).select("normalized").distinct()

    def stems(words: DataFrame, pattern: str, source: str) -> DataFrame:
        stem = F.regexp_replace("normalized", pattern, "")
        return words.select(F.col("normalized").alias("form"), stem.alias("lemma"), F.lit(source).alias("source")).where("form <> lemma and length(lemma) >= 2")

    turns = table(spark, sf_dir, "conversations").select(F.explode(letter_words(F.lower("text"))).alias("normalized")).distinct()
    entries = table(spark, sf_dir, "benchmark").select(F.explode(letter_words(F.lower("text"))).alias("lemma")).distinct()
    spelled = vocabulary.select(F.col("normalized").alias("form"), F.replace("normalized", F.lit("th"), F.lit("t")).alias("other"), F.lit("spelling").alias("source")).where("form <> other")
    return {"forms": stems(vocabulary, _SUFFIX, "suffix").unionByName(stems(vocabulary, _PREFIX, "prefix")), "entries": entries, "listed": stems(turns, _SUFFIX, "turns"), "equivalents": spelled}


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame(list(enumerate(WORDS)), "query_index int, key string")
    return expansion.alternatives(keys, **lexicon(spark, sf_dir))


_EXPANDED = f"""{_TOKENS}, voc AS (SELECT DISTINCT normalized FROM tok), tv AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS normalized FROM conversations),
    forms AS (SELECT * FROM (SELECT normalized AS form, regexp_replace(normalized, '{_SUFFIX}', '') AS lemma, 'suffix' AS source FROM voc UNION ALL SELECT normalized, regexp_replace(normalized, '{_PREFIX}', ''), 'prefix' FROM voc) WHERE form <> lemma AND length(lemma) >= 2),
    entries AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS lemma FROM benchmark),
    listed AS (SELECT * FROM (SELECT normalized AS form, regexp_replace(normalized, '{_SUFFIX}', '') AS lemma, 'turns' AS source FROM tv) WHERE form <> lemma AND length(lemma) >= 2),
    equal AS (SELECT * FROM (SELECT normalized AS form, replace(normalized, 'th', 't') AS other, 'spelling' AS source FROM voc) WHERE form <> other),
    keys(query_index, key) AS (VALUES {", ".join(f"({i}, '{w}')" for i, w in enumerate(WORDS))}),
    heads AS (SELECT DISTINCT query_index, lemma FROM keys JOIN entries ON lemma = key),
    single AS (SELECT query_index, min(lemma) AS lemma FROM keys JOIN forms ON form = key GROUP BY 1 HAVING count(DISTINCT lemma) = 1),
    lem AS (SELECT * FROM heads UNION SELECT * FROM single WHERE query_index NOT IN (SELECT query_index FROM heads)),
    clear AS (SELECT form FROM forms GROUP BY form HAVING count(DISTINCT lemma) = 1),
    found AS (SELECT query_index, key, 'literal' AS kind, key AS form, NULL AS lemma, NULL AS source FROM keys
        UNION SELECT query_index, form, 'attested', form, forms.lemma, source FROM lem JOIN forms USING (lemma) WHERE form IN (SELECT form FROM clear)
        UNION SELECT query_index, form, 'dictionary', form, listed.lemma, source FROM (SELECT * FROM lem UNION SELECT query_index, key FROM keys) h JOIN listed ON listed.lemma = h.lemma
        UNION SELECT query_index, other, 'equivalent', other, NULL, source FROM keys JOIN equal ON form = key),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY query_index, key ORDER BY kind, form, coalesce(lemma, ''), coalesce(source, '')) AS n FROM found),
    expanded AS (SELECT query_index, key, string_agg(concat_ws(':', kind, form, lemma, source), ',' ORDER BY n) FILTER (WHERE n <= 8) AS refs, count(*) AS refs_total FROM numbered GROUP BY 1, 2)"""


@query(f"WITH {_EXPANDED} SELECT query_index, key, refs, refs_total FROM expanded")
def expanded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form that may stand for a query word, and why."""
    refs = F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["kind"], r["form"], r["lemma"], r["source"])), ",")
    return _expanded(spark, sf_dir).withColumn("refs", refs)


@query(f"WITH {_EXPANDED} SELECT id, count(DISTINCT query_index) AS matched, sum(count) AS count FROM tok JOIN expanded ON normalized = key GROUP BY id")
def forms_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with any form of any word.  (A form of two words counts for each.)"""
    return expansion.forms_search(text_tokens(spark, sf_dir), _expanded(spark, sf_dir))


@query(f"WITH {_EXPANDED} SELECT id, sum(count) AS count FROM tok JOIN expanded ON normalized = key GROUP BY id HAVING count(DISTINCT query_index) = {len(WORDS)}")
def all_forms_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a form of every word."""
    return expansion.all_forms_search(text_tokens(spark, sf_dir), _expanded(spark, sf_dir))


@query("""WITH asked AS (SELECT doc_id AS id, CASE WHEN doc_id % 40 = 0 THEN f ELSE strip_accents(f) END AS form FROM (SELECT doc_id, regexp_extract(text, '\\p{L}{5,}') AS f FROM documents WHERE doc_id % 20 = 0) WHERE f <> ''),
    tiles AS (SELECT doc_id AS id, unnest(t) AS form, unnest(range(len(t))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '\\p{L}[\\p{L}\\p{M}]*|[^\\p{L}]+') AS t FROM documents WHERE doc_id % 20 = 0)),
    spans AS (SELECT *, (sum(length(form)) OVER (PARTITION BY id ORDER BY k))::BIGINT AS e FROM tiles),
    met AS (SELECT a.id, a.form AS asked, s.form, e - length(s.form) AS b, e, lower(s.form) = lower(a.form) AS same FROM asked a JOIN spans s ON s.id = a.id AND strip_accents(lower(s.form)) = strip_accents(lower(a.form)) WHERE regexp_matches(s.form, '^\\p{L}')),
    told AS (SELECT id, count(*) AS near, count_if(same) AS exact, arg_min(form, b) AS f, min(b) AS b, min(e) AS e, arg_min(form, b) FILTER (WHERE same) AS xf, min(b) FILTER (WHERE same) AS xb, min(e) FILTER (WHERE same) AS xe FROM met GROUP BY id)
    SELECT a.id, a.form, CASE WHEN exact = 1 THEN 'exact' WHEN exact > 1 THEN 'ambiguous' WHEN near = 1 THEN 'folded' WHEN near > 1 THEN 'ambiguous' ELSE 'none' END AS status,
        CASE WHEN exact = 1 THEN xb WHEN exact = 0 AND near = 1 THEN b END AS start, CASE WHEN exact = 1 THEN xe WHEN exact = 0 AND near = 1 THEN e END AS end, CASE WHEN exact = 1 THEN xf WHEN exact = 0 AND near = 1 THEN f END AS token FROM asked a LEFT JOIN told t ON t.id = a.id""")
def aligned_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of every twentieth document, half of them without their accents, tied to its only place in the text."""
    texts = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), "text")
    word = F.regexp_extract("text", "\\p{L}{5,}", 0)
    asked = texts.select(F.col("id").alias("request_id"), "id", word.alias("form")).where("form <> ''")
    plain = asked.withColumn("form", F.when(F.col("id") % 40 == 0, F.col("form")).otherwise(without_marks("form")))
    found = alignment.align_forms(plain, alignment.word_spans(texts), lowered, lambda word: without_marks(lowered(word)))
    return found.select("id", "form", "status", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "token")


@query("""WITH w AS (SELECT doc_id AS id, lang, regexp_extract_all(text, '\\p{L}+') AS words FROM documents), k AS (SELECT *, array_to_string(words, ' ') AS s FROM w WHERE len(words) >= 8),
    g AS (SELECT lang, s, count(*) AS size, list_sort(list(id)) AS ids FROM k GROUP BY 1, 2 HAVING count(*) > 1),
    t AS (SELECT k.*, lower(words[6]) AS form, len(list_filter(words, lambda x: lower(x) = lower(words[6]))) AS times FROM k WHERE id % 20 = 0)
    SELECT id, form, size - 1 AS matches, array_to_string(list_filter(ids, lambda x: x <> id)[1:10], ',') AS match_ids, len(words)::BIGINT AS words, (list_position(list_transform(words, lambda x: lower(x)), form) - 1)::BIGINT AS token_index,
        array_to_string(words[greatest(list_position(list_transform(words, lambda x: lower(x)), form) - 4, 1):list_position(list_transform(words, lambda x: lower(x)), form) + 4], ' ') AS window FROM t JOIN g USING (lang, s) WHERE times = 1""")
def parallel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixth word of every twentieth document, with the other documents of the language that have all the same words."""
    docs = table(spark, sf_dir, "documents")
    records = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("author"), F.lit(True).alias("usable"), "text")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), F.lower(F.get(letter_words(F.col("text")), F.lit(5))).alias("form")).where("form is not null")
    found = alignment.parallel_contexts(asked, records)
    return found.select("id", "form", "matches", F.array_join("match_ids", ",").alias("match_ids"), F.col("words").cast("long").alias("words"), F.col("token_index").cast("long").alias("token_index"), "window")


@query("""WITH s AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {'label': 'l' || (i - 1) % 10, 'text': x}) AS seq FROM documents),
    r AS (SELECT doc_id, seq, seq[1 + doc_id % 2:3 + doc_id % 2] AS lines FROM s),
    p AS (SELECT *, list_filter(range(len(seq) - len(lines) + 1), lambda i: seq[i + 1:i + len(lines)] = lines) AS pl FROM r WHERE len(lines) > 0),
    o AS (SELECT doc_id, pl[1] AS b, pl[1] + len(lines) AS e, len(seq) AS n, seq[pl[1] + len(lines) + 1].label AS nxt, list_transform(lines, lambda x: x.label) AS labels, CASE WHEN len(seq) <= 3 THEN 1 ELSE 2 END AS readings FROM p WHERE len(pl) = 1),
    j AS (SELECT x.doc_id AS parent_id, y.doc_id AS translation_id, x.b AS parent_start, x.e AS parent_end, y.b AS translation_start, y.e AS translation_end,
        CASE WHEN x.readings = 1 AND y.readings = 1 AND x.b = 0 AND y.b = 0 AND x.e = x.n AND y.e = y.n THEN 'whole_sources' WHEN x.labels = y.labels AND len(list_distinct(x.labels)) = len(x.labels) AND x.nxt IS NOT DISTINCT FROM y.nxt AND (x.e = x.n) = (y.e = y.n) THEN 'same_anchors_and_successor' END AS method
        FROM o x JOIN o y ON y.doc_id = x.doc_id + 2)
    SELECT * FROM j WHERE method IS NOT NULL""")
def proven_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the next but one: whether the lines cut from each have the same boundaries."""
    docs = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.concat(F.lit("l"), i % 10).alias("label"), x.alias("text")))
    sources = docs.select(F.col("doc_id").alias("source_id"), lines.alias("sequence"))
    records = sources.select(F.col("source_id").alias("record_id"), "source_id", F.slice("sequence", (1 + F.col("source_id") % 2).cast("int"), F.lit(3)).alias("lines"))
    readings = sources.select("source_id", F.when(F.size("sequence") <= 3, 1).otherwise(2).alias("readings"))
    pairs = docs.select(F.col("doc_id").alias("parent_id"), (F.col("doc_id") + 2).alias("translation_id"))
    found = alignment.boundary_proofs(pairs, alignment.source_spans(records, sources), readings)
    return found.select("parent_id", "translation_id", "method", *[F.col(c).cast("long").alias(c) for c in ("parent_start", "parent_end", "translation_start", "translation_end")])


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of their source, with a citation."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("_q"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("id"), F.array("source").alias("author_keys"), F.col("lang").alias("language"), F.lit("").alias("edition"), F.lit("text").alias("kind"),
        F.when(F.col("_q") == 0, "mixed_content").otherwise("source_text").alias("quality"), F.concat_ws(" ", "source", F.lit("fr."), F.col("doc_id") % 97).alias("citation"), "text", F.md5(F.concat_ws("|", "lang", "text")).alias("copy_key"),
    )


def _searched(spark: SparkSession, sf_dir: str, text: str, scope: fusion.Scope, page: search.Page) -> DataFrame:
    tokens = text_tokens(spark, sf_dir)
    vocabulary = tokens.select("normalized").where(F.col("normalized").rlike("^[a-z]+$"))
    return search.search(tokens, vocabulary, document_records(spark, sf_dir), text, scope, page)


def _searched_sql(text: str, scope: str, offset: int, limit: int) -> str:
    words = text.lower().split()
    listed = ", ".join(f"'{w}'" for w in words)
    pattern = "(^|[^\\p{L}\\p{N}_])" + "[ \\t\\n\\r\\f]+".join(words) + "([^\\p{L}\\p{N}_]|$)"
    cutoff = 2 if len(words[0]) >= search.LONG_WORD else 1
    near = f"""keys AS (SELECT DISTINCT normalized AS key, levenshtein(normalized, '{words[0]}') AS distance FROM tok WHERE regexp_full_match(normalized, '[a-z]+') AND levenshtein(normalized, '{words[0]}') <= {cutoff} ORDER BY 2, 1 LIMIT 8)"""
    later = (
        "SELECT id, 1 AS stage, count(DISTINCT key) AS matched, -min(distance)::DOUBLE AS score FROM tok JOIN keys ON key = normalized GROUP BY id" if len(words) == 1 else "SELECT id, 2, covered, score FROM scored"
    )
    return f"""WITH {_TOKENS}, {_BM25.format(terms=listed)}, {near},
    rec AS (SELECT doc_id AS id, source, lang, CASE WHEN q = 0 THEN 'mixed_content' ELSE 'source_text' END AS quality, source || ' fr. ' || doc_id % 97 AS citation, text, md5(lang || '|' || text) AS ck FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id)),
    narrow AS (SELECT id, ck, quality <> 'mixed_content' {scope} AS fits FROM rec),
    exact AS (SELECT id FROM rec WHERE regexp_matches(lower(text), '{pattern}') OR regexp_matches(lower(citation), '{pattern}')),
    found AS (SELECT id, 0 AS stage, {len(words)} AS matched, NULL::DOUBLE AS score FROM exact UNION ALL {later}),
    scoped AS (SELECT * FROM found JOIN narrow USING (id) WHERE fits), answers AS (SELECT * FROM scoped WHERE stage = (SELECT min(stage) FROM scoped)),
    shown AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY matched DESC, score DESC NULLS LAST, id) AS k, count(*) OVER (PARTITION BY ck) AS copies, max(matched) OVER (PARTITION BY ck) AS m, max(score) OVER (PARTITION BY ck) AS s FROM answers)
    SELECT id, CASE stage WHEN 0 THEN 'exact' WHEN 1 THEN 'spelling' ELSE 'words' END AS stage, m::BIGINT AS matched, s AS score, copies, (SELECT count(DISTINCT ck) FROM answers) AS total, (SELECT count(*) FROM exact JOIN narrow USING (id) WHERE NOT fits) AS hidden
    FROM shown WHERE k = 1 ORDER BY m DESC, s DESC NULLS LAST, id LIMIT {limit} OFFSET {offset}"""


@query(_searched_sql("of the", "AND lang = 'en'", 20, 30))
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase that stands in texts: its second page, in one language."""
    return _searched(spark, sf_dir, "Of the", fusion.Scope(language="en"), search.Page(20, 30))


@query(_searched_sql("thetionnx", "", 0, 50))
def search_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word that stands nowhere: texts with the nearest spellings."""
    return _searched(spark, sf_dir, "thetionnx", fusion.Scope(), search.Page(0, 50))


@query(_searched_sql("with entre und", "", 0, 50))
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stand together nowhere: texts with any of them."""
    return _searched(spark, sf_dir, "with entre und", fusion.Scope(), search.Page(0, 50))


_CITED = """rec AS (SELECT doc_id AS id, doc_id - 1 AS parent_id, CASE WHEN doc_id % 3 = 1 THEN 'translator' ELSE source END AS author, CASE WHEN doc_id % 3 = 1 THEN 'translation' WHEN doc_id % 11 = 0 THEN 'apparatus' ELSE 'text' END AS kind, lang,
        CASE WHEN doc_id % 7 = 0 THEN 'needs_review' ELSE 'source_text' END AS quality, doc_id % 13 = 0 AS partial,
        CASE doc_id % 6 WHEN 0 THEN 'fr. ' || n_chars % 40 WHEN 1 THEN 'Page ' || n_chars % 40 || ', LP fr. ' || n_chars % 30 || 'a' WHEN 2 THEN 'frag. ' || n_chars % 40 || '-' || n_chars % 40 + 2 WHEN 3 THEN 'fragment ' || n_chars % 40 || ' Voigt' WHEN 4 THEN (n_chars % 40)::VARCHAR ELSE 'fr. ' || n_chars % 40 || '.4' END AS citation FROM documents)"""


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records that cite fragments in several ways; every third is a translation of the one before."""
    i, n = F.col("doc_id"), F.col("n_chars")
    part = lambda m: (n % m).cast("string")
    forms = [F.concat(F.lit("fr. "), part(40)), F.concat(F.lit("Page "), part(40), F.lit(", LP fr. "), part(30), F.lit("a")), F.concat(F.lit("frag. "), part(40), F.lit("-"), (n % 40 + 2).cast("string")), F.concat(F.lit("fragment "), part(40), F.lit(" Voigt")), part(40), F.concat(F.lit("fr. "), part(40), F.lit(".4"))]
    citation = F.element_at(F.array(*forms), (i % 6 + 1).cast("int"))
    kind = F.when(i % 3 == 1, "translation").when(i % 11 == 0, "apparatus").otherwise("text")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), (i - 1).alias("parent_id"), F.when(i % 3 == 1, "translator").otherwise(F.col("source")).alias("author"), F.lit("grc").alias("language"), kind.alias("kind"), F.when(i % 7 == 0, "needs_review").otherwise("source_text").alias("quality"),
        citation.alias("citation"), (i % 2 == 0).alias("collection"), F.lit(True).alias("extracted"), (i % 13 == 0).alias("partial"), F.lit(False).alias("section"),
    )


@query(f"""WITH {_CITED},
    said AS (SELECT id, unnest(regexp_extract_all(citation, '{references.FRAGMENT}')) AS m, 1 AS how FROM rec UNION ALL SELECT id, unnest(regexp_extract_all(citation, '{references.NAMED}')), 2 FROM rec UNION ALL SELECT id, citation, 3 FROM rec WHERE id % 2 = 0 AND regexp_matches(citation, '{references.BARE}')),
    parts AS (SELECT id, CASE how WHEN 1 THEN regexp_extract(m, '{references.FRAGMENT}', 2) WHEN 2 THEN regexp_extract(m, '{references.NAMED}', 2) ELSE regexp_extract(m, '{references.BARE}', 1) END AS number,
        CASE how WHEN 1 THEN coalesce(nullif(regexp_extract(m, '{references.FRAGMENT}', 1), ''), regexp_extract(m, '{references.FRAGMENT}', 4)) WHEN 2 THEN regexp_extract(m, '{references.NAMED}', 1) ELSE regexp_extract(m, '{references.BARE}', 2) END AS scheme,
        CASE how WHEN 1 THEN regexp_extract(m, '{references.FRAGMENT}', 3) WHEN 2 THEN regexp_extract(m, '{references.NAMED}', 3) ELSE '' END AS range FROM said),
    refs AS (SELECT DISTINCT id, lower(number) AS number, lower(scheme) AS scheme FROM parts WHERE range = ''),
    parent AS (SELECT id, author FROM rec WHERE kind = 'text' AND quality = 'source_text'),
    answers AS (SELECT id, author AS whose, false AS by_parent FROM rec UNION ALL SELECT r.id, p.author, true FROM rec r JOIN parent p ON p.id = r.parent_id WHERE r.kind = 'translation' AND r.author <> p.author),
    asked(query_id, author, number, scheme) AS (VALUES (1, 'src1', '12', ''), (2, 'src2', '7', 'voigt'), (3, 'src3', '5a', 'lp'), (4, 'translator', '9', 'page'), (5, 'src4', '3', '')),
    met AS (SELECT query_id, a.id, by_parent, refs.number || CASE WHEN refs.scheme <> '' THEN ' ' || refs.scheme ELSE '' END AS ref FROM asked q JOIN answers a ON lower(whose) = q.author JOIN refs ON refs.id = a.id AND refs.number = q.number AND (q.scheme = '' OR refs.scheme = q.scheme))
    SELECT query_id, m.id, CASE WHEN kind = 'apparatus' THEN 'reference_only' WHEN quality = 'needs_review' THEN 'needs_review' WHEN partial THEN 'partial_text' ELSE kind END AS coverage, min(by_parent) AS by_parent, citation, refs
    FROM (SELECT query_id, id, min(by_parent) AS by_parent, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs FROM met GROUP BY 1, 2) m JOIN rec ON rec.id = m.id GROUP BY ALL""")
def cited_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that state a number, by their author or that of the text they translate."""
    asked = [(1, "src1", "12", None), (2, "SRC2", "7", "Voigt"), (3, "src3", "5a", "LP"), (4, "translator", "9", "Page"), (5, "src4", "3", "")]
    found = references.cited_records(_citations(spark, sf_dir), spark.createDataFrame(asked, "query_id int, author string, number string, scheme string"))
    return found.select("query_id", "id", "coverage", "by_parent", "citation", "refs")


@query(f"WITH {_TOKENS} SELECT normalized, min(form) AS form, sum(count) AS count FROM tok GROUP BY 1")
def patched_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary after every tenth document came in later: the same as one made anew."""
    docs = table(spark, sf_dir, "documents")
    old, news = (lexical.token_table(docs.where(which)) for which in ("doc_id % 10 <> 0", "doc_id % 10 = 0"))
    return audit.patched(old, lexical.vocabulary(old), news)[1].select("normalized", "form", "count")


@query("""WITH o AS (SELECT doc_id, source, lang, doc_id % 10 = 0 AS late FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY late, doc_id) - 1 AS sequence FROM o) SELECT doc_id, source, lang, sequence FROM p WHERE late""")
def placed_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document, placed in its work behind those that were there."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    works = rows.where("doc_id % 10 <> 0").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("count"))
    return audit.appended_works(works, rows.where("doc_id % 10 = 0"), ["source", "lang"], ["doc_id"])[1]


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey, o_orderstatus FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal, o_orderkey, o_orderstatus FROM orders)
    SELECT a.ordinal, a.o_orderkey AS recorded, b.o_orderkey AS dated, a.o_orderstatus = b.o_orderstatus AS same_status FROM a JOIN b USING (ordinal) WHERE a.o_orderkey <> b.o_orderkey""")
def misplaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of the same rows, line by line: those that don't stand where their dates would put them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    both = audit.zipped(audit.with_ordinals(orders, ["o_orderkey"]), audit.with_ordinals(orders, ["o_orderdate", "o_orderkey"]))
    apart = both.where("left.o_orderkey <> right.o_orderkey")
    return apart.select("ordinal", F.col("left.o_orderkey").alias("recorded"), F.col("right.o_orderkey").alias("dated"), (F.col("left.o_orderstatus") == F.col("right.o_orderstatus")).alias("same_status"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as answers of a service: entries with one inflection or a list of them; one in seventeen is broken."""
    words = F.split("p_type", " ")
    one = lambda w: F.struct((F.col("p_size") % 5).alias("size"), w.alias("pofs"))
    entry = lambda infl: F.struct(F.struct(F.col("p_brand").alias("hdwd")).alias("dict"), infl.alias("infl"))
    answer = lambda infl: F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(entry(infl).alias("entry")).alias("rest"))).alias("Body")).alias("Annotation")))
    text = F.when(F.col("p_partkey") % 3 == 0, answer(one(words[0]))).otherwise(answer(F.transform(words, one)))
    broken = F.when(F.col("p_partkey") % 17 == 0, F.lit('{"Annotation": {}, "Annotation": {}}')).otherwise(text)
    return table(spark, sf_dir, "part").select("p_partkey", nested.parsed(broken).alias("answer"))


@query("""WITH w AS (SELECT p_partkey, p_brand, p_size % 5 AS size, string_split(p_type, ' ') AS ws FROM part WHERE p_partkey % 17 <> 0),
    i AS (SELECT p_partkey, p_brand, size, ws[1] AS pofs, '/Annotation/Body/0/rest/entry/infl' AS pointer FROM w WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_partkey, p_brand, size, unnest(ws), '/Annotation/Body/0/rest/entry/infl/' || unnest(range(len(ws))) FROM w WHERE p_partkey % 3 <> 0),
    c AS (SELECT *, 'lemma="' || p_brand || '"' || chr(10) || 'features={"pofs":"' || pofs || '","size":' || size || '}' AS content FROM i)
    SELECT content, sha256(content) AS sha256, count(*) AS members, count(DISTINCT p_partkey) AS parts, min(pointer) AS first_pointer FROM c GROUP BY content""")
def equal_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflections of equal lemma and features, wherever they stand in the answers."""
    rows = nested.nested_items(analyses(spark, sf_dir), "answer", ["Annotation", "Body", "rest/entry", "infl"], ["p_partkey"])
    lemma = F.try_variant_get("value_2", "$.dict.hdwd", "variant")
    return nested.equal_content(rows, {"lemma": lemma, "features": F.col("value_3")}, F.countDistinct("p_partkey").alias("parts"), F.min("pointer_3").alias("first_pointer"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, sha256('{\"k\":' || (props::JSON->>'k') || '}') AS sha256 FROM events")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a property and the hash of all of them in canonical form."""
    rows = table(spark, sf_dir, "events").select("event_id", nested.parsed(F.col("props")).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.sha2(nested.canonical(F.col("v")), 256).alias("sha256"))


_PLAIN = "replace(strip_accents(lower({0})), 'ß', 'ss')"
_ENDING = "regexp_replace(key, '{0}', '') AS lemma, regexp_extract(key, '{0}', 1) AS analysis, '{1}' AS source"


@query(f"""WITH {_TOKENS}, askw AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS word FROM benchmark),
    spelt AS (SELECT word, {_PLAIN.format("word")} AS key FROM askw), asked AS (SELECT word, key, 0 AS variant FROM spelt UNION ALL SELECT word, replace(key, 'th', 't'), 1 FROM spelt WHERE contains(key, 'th')),
    base AS (SELECT id, form, {_PLAIN.format("normalized")} AS key FROM tok),
    ended AS (SELECT * FROM (SELECT id, form, key, {_ENDING.format(_SUFFIX, "suffix")} FROM base UNION ALL SELECT id, form, key, {_ENDING.format(_PREFIX, "prefix")} FROM base) WHERE key <> lemma AND length(lemma) >= 2),
    forms AS (SELECT DISTINCT form, key, lemma, analysis, source FROM ended),
    entries AS (SELECT role || ':' || w AS entry_id, w AS lemma, {_PLAIN.format("w")} AS key, role AS source, min(conv_id)::VARCHAR AS gloss FROM (SELECT conv_id, role, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS w FROM conversations) GROUP BY role, w),
    known AS (SELECT key FROM forms UNION SELECT key FROM entries),
    direct AS (SELECT word, key, 0 AS distance, min(variant) AS variant FROM asked WHERE key IN (SELECT key FROM known) GROUP BY word, key),
    rest AS (SELECT * FROM asked WHERE word NOT IN (SELECT word FROM direct)), ask AS (SELECT DISTINCT key AS word FROM rest), voc AS (SELECT key AS normalized FROM known),
    vg AS (SELECT DISTINCT normalized, gram FROM (SELECT normalized, substr('^' || normalized || '$', unnest(range(1, length(normalized) + 1)), 3) AS gram FROM voc)),
    ag AS (SELECT DISTINCT word, gram FROM (SELECT word, substr('^' || word || '$', unnest(range(1, length(word) + 1)), 3) AS gram FROM ask WHERE length(word) >= 5)),
    sizes AS (SELECT gram, count(*) AS postings FROM vg GROUP BY 1),
    rare AS (SELECT word, gram FROM (SELECT word, gram, row_number() OVER (PARTITION BY word ORDER BY postings, gram) AS k FROM ag JOIN sizes USING (gram)) WHERE k <= 5),
    pool AS (SELECT DISTINCT word, normalized FROM rare JOIN vg USING (gram) UNION SELECT word, normalized FROM ask JOIN voc ON word[1] = normalized[1] AND abs(length(word) - length(normalized)) <= CASE WHEN length(word) < 6 THEN 1 ELSE 2 END WHERE length(word) < 5 OR (length(word) <= 6 AND length(normalized) < 5)),
    near AS (SELECT word, normalized, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, normalized) AS k FROM (SELECT *, levenshtein(word, normalized) AS distance FROM pool) WHERE distance <= CASE WHEN length(word) < 6 THEN 1 ELSE 2 END) WHERE k <= 80),
    met AS (SELECT rest.word, normalized AS key, distance, variant, row_number() OVER (PARTITION BY rest.word, normalized ORDER BY distance, variant) AS k FROM rest JOIN near ON rest.key = near.word),
    matches AS (SELECT * FROM direct UNION ALL SELECT word, key, distance, variant FROM met WHERE k = 1),
    hits AS (SELECT f.lemma, e.lemma = f.lemma AS exact, entry_id, e.source, e.gloss FROM (SELECT DISTINCT lemma FROM forms) f JOIN entries e ON e.key = f.lemma),
    per AS (SELECT lemma, exact, source, count(*) AS n FROM hits GROUP BY ALL), most AS (SELECT lemma, exact, max(n) AS n FROM per GROUP BY ALL),
    side AS (SELECT h.*, row_number() OVER (PARTITION BY lemma ORDER BY exact DESC, source, entry_id) AS k FROM hits h),
    told AS (SELECT s.lemma, CASE WHEN m.n = 1 THEN gloss END AS gloss FROM side s JOIN most m ON m.lemma = s.lemma AND m.exact = s.exact WHERE k = 1),
    place AS (SELECT word, min(id) AS passage FROM spelt JOIN base USING (key) GROUP BY word),
    noted AS (SELECT key, lemma, analysis, id, d.source AS author FROM ended JOIN labels ON id = labels.doc_id AND quality = 1 JOIN documents d ON d.doc_id = id),
    support AS (SELECT s.word, n.lemma, n.analysis, bool_or(n.id = passage) AS in_passage, coalesce(bool_or(n.author = d.source), false) AS same_author FROM spelt s JOIN place USING (word) JOIN documents d ON d.doc_id = passage JOIN noted n USING (key) GROUP BY ALL),
    cand AS (SELECT m.*, 'form' AS kind, f.lemma, f.analysis, NULL AS entry_id, f.form, t.gloss, f.source, coalesce(in_passage, false) AS p, coalesce(same_author, false) AS a FROM matches m JOIN forms f USING (key) LEFT JOIN told t ON t.lemma = f.lemma LEFT JOIN support u ON u.word = m.word AND u.lemma = f.lemma AND u.analysis = f.analysis
        UNION ALL SELECT m.*, 'lemma', e.lemma, NULL, e.entry_id, e.lemma, e.gloss, e.source, false, false FROM matches m JOIN entries e USING (key)),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY word, kind, lemma, analysis, entry_id ORDER BY distance, form <> word, variant, source, form) AS k FROM cand),
    counts AS (SELECT word, kind, lemma, coalesce(analysis, '') AS ana, coalesce(entry_id, '') AS ent, count(DISTINCT source) AS n_sources, count(DISTINCT form) AS n_forms FROM cand GROUP BY ALL),
    ranked AS (SELECT f.*, n_sources, n_forms, row_number() OVER (PARTITION BY f.word ORDER BY distance, p DESC, a DESC, form <> f.word, variant, f.kind, f.lemma, analysis, source, entry_id, form) AS rank
        FROM firsts f JOIN counts c ON c.word = f.word AND c.kind = f.kind AND c.lemma = f.lemma AND ana = coalesce(analysis, '') AND ent = coalesce(entry_id, '') WHERE k = 1)
    SELECT word AS query_id, rank, kind, lemma, NULL::VARCHAR AS marker, analysis, entry_id, form AS matched_form, distance::BIGINT AS distance, gloss, n_sources, n_forms,
        CASE WHEN distance > 0 THEN 'near spelling, distance ' || distance WHEN variant > 0 THEN 'another spelling of the word' WHEN form = word THEN 'the very ' || CASE kind WHEN 'form' THEN 'form' ELSE 'headword' END ELSE CASE kind WHEN 'form' THEN 'form' ELSE 'headword' END || ' of the same letters' END
            || CASE WHEN p THEN '; annotated in the passage' WHEN a THEN '; annotated in the author''s texts' ELSE '' END AS reason FROM ranked WHERE rank <= 12""")
def word_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark analysed: forms by their endings in the documents, headwords from the turns; labelled good documents are the annotated ones."""
    tokens, docs = text_tokens(spark, sf_dir), table(spark, sf_dir, "documents")
    spelt = table(spark, sf_dir, "benchmark").select(F.explode(letter_words(F.col("text"))).alias("word")).distinct().withColumn("key", _spelling(F.lower("word")))
    asked = spelt.withColumn("variant", F.lit(0)).unionByName(spelt.where(F.contains("key", F.lit("th"))).withColumns({"key": F.replace("key", F.lit("th"), F.lit("t")), "variant": F.lit(1)}))
    asked = asked.withColumn("query_id", F.col("word"))

    def ended(rows: DataFrame, pattern: str, source: str) -> DataFrame:
        found = rows.withColumns({"lemma": F.regexp_replace("key", pattern, ""), "analysis": F.regexp_extract("key", pattern, 1), "source": F.lit(source)})
        return found.where("key <> lemma and length(lemma) >= 2").withColumn("lemma_key", F.col("lemma"))

    # keys are made once for each form, not for each text that has it
    spelled = materialized(tokens.select("form", "normalized").distinct().select("form", _spelling(F.col("normalized")).alias("key")), "spelled")
    forms = materialized(ended(spelled, _SUFFIX, "suffix").unionByName(ended(spelled, _PREFIX, "prefix")).withColumn("marker", F.lit(None).cast("string")), "forms")
    placed = tokens.select("id", "form")
    words = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(letter_words(F.col("text"))).alias("lemma"))
    heads = words.groupBy("role", "lemma").agg(F.min("conv_id").cast("string").alias("gloss"))
    entries = heads.select(F.concat_ws(":", "role", "lemma").alias("entry_id"), "lemma", _spelling(F.lower("lemma")).alias("key"), F.col("role").alias("source"), "gloss")
    entries = materialized(entries, "entries")
    first = spelt.join(spelled, "key").join(placed, "form").groupBy(F.col("word").alias("query_id")).agg(F.min("id").alias("passage_id"))
    contexts = first.join(docs.select(F.col("doc_id").alias("passage_id"), F.col("source").alias("author_id")), "passage_id").select("query_id", "passage_id", "author_id")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    annotated = forms.join(spelt.select("key").distinct(), "key", "left_semi").join(placed, "form").join(good, "id", "left_semi").join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("author_id")), "id")
    occurrences = annotated.select("key", "lemma_key", "analysis", F.col("id").alias("passage_id"), "author_id")
    return inflection.analyses(asked, forms, entries, inflection.supports(asked, contexts, occurrences))
