"""Gate, build, replacement and markup on files made here."""

import hashlib
import json

import pytest

from tessera.sources import corpus, markup


def record(i, **more):
    return {"id": f"r{i}", "source": "s", "source_url": "http://x", "raw_path": "p", "raw_sha256": "0" * 64, "author": "A / B", "language": "grc", "kind": "text", "quality": "source_text", "text": f"λόγος {i} λόγος"} | more


def write(folder, name, records):
    body = "\n".join(json.dumps(r, ensure_ascii=False) if isinstance(r, dict) else r for r in records) + "\n"
    (folder / name).write_text(body, encoding="utf-8")
    return {"verdict": "PASS", "sha256": hashlib.sha256(body.encode()).hexdigest(), "records": sum(bool(r) for r in records)}


def test_build(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    files = {"a.jsonl": write(source, "a.jsonl", [record(1), "", record(2, kind="odd", quality=None, author="")])}
    write(source, "b.jsonl", [record(3)])
    made = corpus.build_corpus(spark, str(source), {"files": files}, str(target))
    assert made["passages"] == 2 and made["quarantined"] == {"b.jsonl": "not in the manifest"}
    passages = {r["id"]: r for r in spark.read.parquet(f"{target}/passages").collect()}
    assert passages["r2"]["kind"] == "reference" and passages["r2"]["quality"] == "needs_review" and passages["r2"]["author"] == "unknown"
    assert {tuple(r) for r in spark.read.parquet(f"{target}/vocabulary").collect()} == {("λογοσ", "λόγος", 2)}
    assert {r["author_key"] for r in spark.read.parquet(f"{target}/passage_authors").collect()} == {"a", "b", "unknown"}


@pytest.mark.parametrize("bad", [record(1, text=" "), record(2), "not json"])
def test_a_bad_row_keeps_the_old_tables(spark, tmp_path, bad):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    corpus.build_corpus(spark, str(source), {"files": {"a.jsonl": write(source, "a.jsonl", [record(2)])}}, str(target))
    files = {"a.jsonl": write(source, "a.jsonl", [record(2), bad])}
    with pytest.raises(corpus.Rejected):
        corpus.build_corpus(spark, str(source), {"files": files}, str(target))
    assert spark.read.parquet(f"{target}/passages").count() == 1


def test_counts_and_hashes_gate(spark, tmp_path):
    entry = write(tmp_path, "a.jsonl", [record(1)])
    assert corpus.gate(str(tmp_path), {"files": {"a.jsonl": entry | {"sha256": "0" * 64}}}).quarantined == {"a.jsonl": "other content than accepted"}
    assert corpus.gate(str(tmp_path), {"files": {"a.jsonl": entry | {"verdict": "FAIL"}}}).quarantined == {"a.jsonl": "verdict FAIL"}
    with pytest.raises(corpus.Rejected):
        corpus.build_corpus(spark, str(tmp_path), {"files": {"a.jsonl": entry | {"records": 2}}}, str(tmp_path / "out"))


def test_claims(spark, tmp_path):
    good = {"id": "c", "subject": {"type": "form", "passage_id": "p", "start": 0, "end": 3}, "predicate": "lemma", "object": "x", "evidence": [{"record_id": "r", "raw_sha256": "a" * 64, "quote": "q"}], "assertion_type": "quoted_source", "status": "source_claim"}
    write(tmp_path, "c.jsonl", [good, good | {"id": "d", "predicate": "guess"}, good | {"id": "e", "evidence": []}, good | {"id": "f", "subject": {"passage_id": "p", "start": 4, "end": 3}}, good | {"id": "g", "status": "sure"}, good | {"id": "h", "assertion_type": "guess"}, good | {"id": "i", "predicate": "parallel_proposal"}])
    claims = corpus.read_claims(spark, [str(tmp_path / "c.jsonl")])
    assert {tuple(r) for r in corpus.broken_claims(claims).collect()} == {("d", "unknown predicate"), ("e", "no evidence"), ("f", "offsets out of order"), ("g", "unknown status"), ("h", "unknown assertion type")}


def test_visible_text(spark):
    page = "<html><head><title>no</title></head><body><p>One&nbsp;two<br>three</p><script>no()</script><!-- no --><div>f&amp;g</div></body></html>"
    assert markup.visible_text(page) == "One two\nthree\nf&g"
    assert markup.visible_text(None) == ""
    df = spark.createDataFrame([(page,), (None,)], "html string")
    assert [r[0] for r in df.select(markup.tagless(df["html"])).collect()] == ["One two three f&g", None]


def test_tei_and_other_markup(spark, tmp_path):
    lines = "".join(f'<l n="{i}">line {i}</l>' for i in range(1, 26))
    (tmp_path / "t.xml").write_text(f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div n="1"><lg>{lines}</lg></div><div n="2"><p>some <hi>prose</hi></p></div></body></text></TEI>')
    rows = markup.read_tei(spark, str(tmp_path / "t.xml")).orderBy("place").collect()
    assert [(r["citation"], r["kind"], len(r["lines"])) for r in rows] == [("1.1", "verse", 20), ("1.21", "verse", 5), ("2.1", "prose", 0)]
    assert rows[2]["text"] == "some prose"
    assert markup.strip_wikitext("''a'' {{t|{{u}}}}[[b|c]]<ref>x</ref> [[d]]") == "a c d"
    (tmp_path / "t.md").write_text("| a | b |\n| --- | --- |\n| 1 | 2 |\ntext\n")
    table = markup.markdown_tables(corpus.read_lines(spark, [str(tmp_path / "t.md")]))
    assert [r["cells"] for r in table.orderBy("line_no").collect()] == [["a", "b"], ["1", "2"]]


def test_years():
    assert markup.year_interval("-0612-00-00T00:00:00Z", 9) == (-612, -612)
    assert markup.year_interval("-0600-00-00T00:00:00Z", 7) == (-600, -501)
    assert markup.year_interval("+0150-00-00T00:00:00Z", 7) == (101, 200)
    assert markup.year_interval("-0625-00-00T00:00:00Z", 8) == (-630, -621)
    assert markup.year_interval("+1985-00-00T00:00:00Z", 8) == (1980, 1989)
