"""Filters, links, audits, limits and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import audit, graph, lexical
from tessera.plans.registry import query, table
from tessera.plans.text import _DOCS, documents
from tessera.plans.vectors import _PARENTS, _turns
from tessera.sources.markup import segments, tagless, visible_text_column
from tessera.streaming import limits


@query("""SELECT DISTINCT doc_id, source FROM documents d WHERE source = 'src3' OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) OR EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)""")
def filter_scope_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ways into a scope, one equality each; the union of identifiers keeps Spark from a nested loop."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    quoted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    scope = docs.where("source = 'src3'").select("doc_id").union(toxic).union(quoted).distinct()
    return docs.join(scope, "doc_id", "left_semi").distinct()


@query(f"WITH {_PARENTS} SELECT id, role FROM link a WHERE EXISTS (SELECT 1 FROM link b WHERE b.parent_id = a.id AND b.role = 'assistant')")
def semi_linked_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    answered = turns.where("role = 'assistant'").select(F.col("parent_id").alias("_p"))
    return turns.select("id", "role").join(answered, F.col("id") == F.col("_p"), "left_semi")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT conv_id, turn, role, lag(turn) OVER w AS previous_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn")
    return rows.select("conv_id", "turn", "role", F.col("previous_id").alias("previous_turn"), F.col("next_id").alias("next_turn"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents)
    SELECT doc_id, k // 20 AS chunk, min(k) AS first_line, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY k)) AS digest FROM l GROUP BY 1, 2""")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of twenty lines; arrays keep each text in its row, so nothing is shuffled."""
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 20).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).select("doc_id", "lines", F.explode(starts).alias("chunk"))
    part = F.slice("lines", F.col("chunk") * 20 + 1, F.lit(20))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * 20).cast("long").alias("first_line"), F.size(part).cast("long").alias("lines"), F.md5(F.array_join(part, "\n")).alias("digest"))


@query("""WITH l AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l""")
def carried_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", graph.carry_forward(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn"))).alias("heading"))


_RULES = """SELECT doc_id AS id, 'error' AS severity, 'blank_text' AS code FROM documents WHERE trim(coalesce(text, '')) = ''
    UNION ALL SELECT doc_id, 'error', 'wrong_length' FROM documents WHERE n_chars <> length(text)
    UNION ALL SELECT doc_id, 'warning', 'many_symbols' FROM documents WHERE len(regexp_extract_all(text, '[&%$#*]')) * 10 > length(text)
    UNION ALL SELECT doc_id, 'warning', 'short_text' FROM documents WHERE length(text) < 80"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        ("blank_text", "error", F.trim(F.coalesce("text", F.lit(""))) == ""),
        ("wrong_length", "error", F.col("n_chars") != F.length("text")),
        ("many_symbols", "warning", F.regexp_count("text", F.lit("[&%$#*]")) * 10 > F.length("text")),
        ("short_text", "warning", F.length("text") < 80),
    ]
    return audit.findings(table(spark, sf_dir, "documents"), "doc_id", rules)


@query(_RULES)
def row_audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@query(f"""WITH f AS ({_RULES}), c AS (SELECT id, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings FROM f GROUP BY 1),
    s AS (SELECT source, count(*) AS records, coalesce(sum(errors), 0)::BIGINT AS errors, coalesce(sum(warnings), 0)::BIGINT AS warnings FROM documents LEFT JOIN c ON id = doc_id GROUP BY 1)
    SELECT *, CASE WHEN errors > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM s""")
def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.verdicts(table(spark, sf_dir, "documents"), _findings(spark, sf_dir), "source", "doc_id")


_AFTER = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 13 <> 0"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    after = before.where("o_orderkey % 13 != 0").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.when(F.col("o_orderkey") % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
    })
    return before, after


@query(f"""WITH a AS ({_AFTER}) SELECT o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN a.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.o_totalprice <> b.o_totalprice THEN 'o_totalprice' END) END AS changed_fields
    FROM orders b LEFT JOIN a USING (o_orderkey) WHERE a.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.o_totalprice <> b.o_totalprice""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.snapshot_diff(*_snapshots(spark, sf_dir), "o_orderkey")


@query(f"""WITH a AS ({_AFTER}), b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders) SELECT *, 'left' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'right' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def except_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.table_difference(*_snapshots(spark, sf_dir))


@query(f"""WITH a AS ({_AFTER}), n AS (SELECT * FROM a WHERE o_orderkey % 7 = 0) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n""")
def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return audit.upsert(before, after.where("o_orderkey % 7 = 0"), "o_orderkey")


@query("SELECT doc_id, md5(text) AS text_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def incremental_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that no checkpoint has in this version (labelled 1 stands for done)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_hash"))
    done = rows.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return audit.incremental(rows, done, ["doc_id", "text_hash"])


@query("""WITH e AS (SELECT doc_id AS id, form, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{L}+')) AS form FROM documents) GROUP BY ALL),
    s AS (SELECT id, form, CASE WHEN id % 50 = 0 AND form = 'the' THEN n + 1 ELSE n END AS n FROM e WHERE NOT (id % 70 = 0 AND form IN ('of', 'de'))) SELECT id, count(*) AS differing FROM e FULL JOIN s USING (id, form) WHERE e.n IS DISTINCT FROM s.n GROUP BY id""")
def stale_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = lexical.token_table(table(spark, sf_dir, "documents")).select("id", "form", "count")
    kept = expected.where(~((F.col("id") % 70 == 0) & F.col("form").isin("of", "de")))
    stored = kept.withColumn("count", F.when((F.col("id") % 50 == 0) & (F.col("form") == "the"), F.col("count") + 1).otherwise(F.col("count")))
    return audit.stale_tokens(expected, stored)


@query("""WITH l AS (SELECT doc_id, source, sha256(lower(trim(l))) AS s FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) >= 32),
    n AS (SELECT DISTINCT doc_id, s FROM l WHERE source IN ('src1', 'src2', 'src3', 'src4')), b AS (SELECT s, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_id FROM l WHERE source NOT IN ('src1', 'src2', 'src3', 'src4') GROUP BY 1)
    SELECT doc_id, count(*) AS shared_lines, max(documents) AS documents, min(first_id) AS first_id FROM n JOIN b USING (s) GROUP BY 1""")
def exact_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of new documents (four sources) that accepted ones have already: an equality join on a digest."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("l")).where("length(l) >= 32")
    signed = lines.select("doc_id", F.col("source").isin("src1", "src2", "src3", "src4").alias("new"), F.sha2(F.lower(F.trim("l")), 256).alias("s"))
    baseline = signed.where("not new").groupBy("s").agg(F.countDistinct("doc_id").alias("documents"), F.min("doc_id").alias("first_id"))
    shared = signed.where("new").select("doc_id", "s").distinct().join(baseline, "s")
    return shared.groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared_lines"), F.max("documents").alias("documents"), F.min("first_id").alias("first_id"))


@query("""WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_orderkey * 8 + l_linenumber AS id FROM lineitem), s AS (SELECT * FROM a WHERE id % 20 = 0),
    r AS (SELECT s.id AS seed_id, a.id AS related_id, 1 AS priority FROM s JOIN a ON s.l_orderkey = a.l_orderkey WHERE s.id <> a.id UNION ALL SELECT s.id, a.id, 2 FROM s JOIN a ON s.l_partkey = a.l_partkey WHERE s.id <> a.id)
    SELECT seed_id, related_id, min(priority) AS priority, CASE min(priority) WHEN 1 THEN 'shared_subject' ELSE 'shared_form' END AS strength FROM r GROUP BY 1, 2""")
def related_claims_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines related to every line whose identifier is divisible by 20: by order first, then by part."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return graph.related(rows, [("shared_subject", F.col("l_orderkey"), 1), ("shared_form", F.col("l_partkey"), 2)], "id", rows.where("id % 20 = 0"))


@query("""WITH c AS (SELECT p_partkey, string_split(p_name, ' ') AS f FROM part) SELECT p_partkey AS claim_id, unnest(range(0, len(f))) AS ordinal, unnest(f) AS form, lower(unnest(f)) AS normalized FROM c""")
def form_edges_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("forms"))
    return graph.form_edges(claims, "p_partkey", "forms").withColumn("ordinal", F.col("ordinal").cast("long"))


@query("""WITH e AS (SELECT p_partkey AS id, lower(p_type) AS head, list_transform(string_split(p_name, ' '), lambda x: lower(x)) AS f FROM part), k AS (SELECT head AS key, id, 0 AS rank, NULL::BIGINT AS i FROM e UNION ALL SELECT unnest(f), id, 1, unnest(range(0, len(f))) FROM e),
    w AS (SELECT key FROM k GROUP BY key ORDER BY count(*) DESC, key LIMIT 1) SELECT id AS entry_id, min(rank) AS rank, coalesce(array_to_string(list_slice(list_sort(list(DISTINCT i) FILTER (WHERE i IS NOT NULL)), 1, 5), ','), '') AS matched FROM k JOIN w USING (key) GROUP BY id ORDER BY rank, id LIMIT 20""")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("headword"), F.split("p_name", " ").alias("forms"))
    keys = graph.dictionary_keys(entries)
    most = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").first()["key"]
    return graph.dictionary_lookup(keys, most).select("entry_id", "rank", F.array_join(F.transform("matched_forms", lambda i: i.cast("string")), ",").alias("matched"))


@query("""WITH f AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS k FROM f),
    g AS (SELECT p_brand, count(*) AS forms_total, sum(n)::BIGINT AS occurrences, array_to_string(list_sort(list(p_type) FILTER (WHERE k <= 50)), ',') AS forms FROM k GROUP BY 1),
    l AS (SELECT p_brand, array_to_string(list_sort(list(p_partkey)), ',') AS locations FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) WHERE k <= 20 GROUP BY 1)
    SELECT g.*, locations, forms_total > 50 AS truncated FROM g JOIN l USING (p_brand)""")
def lexicon_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inventory(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_partkey")


@query("SELECT key, min(p_name) AS p_name FROM (SELECT p_type || '/' || p_size || '/' || p_brand AS key, p_name FROM part) GROUP BY 1 HAVING count(DISTINCT p_name) = 1")
def unambiguous_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", F.col("p_size").cast("string"), "p_brand").alias("key"), "p_name")
    return graph.unambiguous(rows, "key", "p_name")


@query("""WITH p AS (SELECT DISTINCT c_custkey % 997 AS l, c_nationkey * 10000 + c_custkey % 1999 AS r FROM customer) SELECT l, r FROM (SELECT *, count(*) OVER (PARTITION BY l) AS a, count(*) OVER (PARTITION BY r) AS b FROM p) WHERE a = 1 AND b = 1""")
def mutually_unique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 997).alias("l"), (F.col("c_nationkey") * 10000 + F.col("c_custkey") % 1999).alias("r"))
    return graph.mutually_unique(pairs, "l", "r")


@query("""SELECT s_suppkey, n_name, r_name, count(*) OVER (PARTITION BY n_nationkey) AS members FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def author_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels resolved by small dimension tables (Spark sees their sizes and broadcasts them)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("s_suppkey", "n_name", "r_name", F.count(F.lit(1)).over(Window.partitionBy("n_nationkey")).alias("members"))


_EVENTS = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"


@query(f"WITH {_EVENTS} SELECT event_id, user_id, count(*) OVER w AS attempts, min(us) OVER w AS oldest FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)")
def visitor_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.attempts_before(table(spark, sf_dir, "events"), 3600).select("event_id", "user_id", "attempts", "oldest")


@query(f"WITH {_EVENTS} SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, us // 86400000000 ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS today FROM e")
def visitor_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.attempts_today(table(spark, sf_dir, "events")).select("event_id", "user_id", "today")


@query(f"""WITH {_EVENTS}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w > 7200000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM n)
    SELECT user_id, session::BIGINT AS session, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, count(*) AS events FROM s GROUP BY 1, 2""")
def visitor_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = limits.sessions(table(spark, sf_dir, "events"), 7200)
    return rows.select("user_id", F.col("session").cast("long").alias("session"), limits.epoch("first_at").alias("first_at"), limits.epoch("last_at").alias("last_at"), "events")


@query(f"""WITH {_EVENTS}, l AS (SELECT event_id AS id, us AS s, us + 600000000 AS f FROM e), p AS (SELECT id, s AS us, 1 AS step FROM l UNION ALL SELECT id, f, -1 FROM l),
    o AS (SELECT id, step, sum(step) OVER (ORDER BY us, step, id) AS open FROM p) SELECT id, open::BIGINT AS open FROM o WHERE step = 1""")
def lease_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many leases of ten minutes are open when each begins."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), limits.epoch("ts").alias("start"))
    return limits.overlapping_leases(rows.withColumn("end", F.col("start") + 600_000_000))


@query(f"""WITH {_EVENTS}, w AS (SELECT user_id AS key, us, event_id AS id FROM e WHERE event_id % 3 = 0), r AS (SELECT user_id AS key, us, event_id AS id FROM e WHERE event_id % 3 <> 0),
    j AS (SELECT r.id AS read_id, r.key, r.us, w.id, w.us AS wat, row_number() OVER (PARTITION BY r.id ORDER BY w.us DESC, w.id DESC) AS k FROM r LEFT JOIN w ON w.key = r.key AND w.us <= r.us)
    SELECT read_id, key, CASE WHEN us - wat <= 86400000000 THEN id END AS write_id FROM j WHERE k = 1""")
def live_cache_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest write before each read that has not expired: an as-of join in one ordered pass."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), limits.epoch("ts").alias("at"), F.col("event_id").alias("id"))
    return limits.live_cache(rows.where("id % 3 = 0"), rows.where("id % 3 != 0"), 86_400)


@query()
def admit_deny_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission that depends on what was admitted before: sequential by user, beyond SQL."""
    return limits.admit_batch(table(spark, sf_dir, "events"), 2, 5)


@query("""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style|head)\\b.*?</(script|style|head)>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS digest FROM pages""")
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tagless(F.col("html"))).alias("digest"))


@query()
def html_parsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text by a real parser, a line for each block."""
    return table(spark, sf_dir, "pages").select("page_id", visible_text_column("html").alias("text"))


@query()
def html_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut at their headings."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(segments(F.col("html"), "<h[1-6][^>]*>")).alias("place", "s")).select("page_id", "place", "s.reference", "s.body")


@query("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, count(json_extract(props, '$')) AS with_props FROM events GROUP BY 1")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"), F.count(F.get_json_object("props", "$")).alias("with_props"))


@query(f"WITH {_DOCS} SELECT doc_id, source FROM docs WHERE quality = 'source_text' AND (source, lang) IN (('src1', 'en'), ('src2', 'en'), ('src3', 'fr'))")
def publication_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose pair of source and licence (here: language) may be published."""
    allowed = spark.createDataFrame([("src1", "en"), ("src2", "en"), ("src3", "fr")], "source string, lang string")
    return documents(spark, sf_dir).where("quality = 'source_text'").join(F.broadcast(allowed), ["source", "lang"], "left_semi").select("doc_id", "source")
