"""Words tied to their place, against the SQL on texts that the tables don't have: inner capitals, sigmas, other scripts' marks, one identifier twice."""

import duckdb

import __spark_entry__ as entry

TEXTS = [
    (20, "JavaScript and javascript"), (40, "JavaScript and javascript"), (60, "McÉtat d'un mcetat"), (100, "ÉCOLES, Écoles et écoles"), (140, "ΟΔΟΣΑΣ οδοσασ οδοσας"),
    (180, "ΛΌΓΟΣ λογοσ"), (200, "ΛΌΓΟΣ λόγοσ λόγος"), (220, "नमस्ते कमलनयन कमलनयनी"), (260, "한국어로말하기 한국어로말하기"), (300, "가나다라마 fin"), (340, "Straße STRASSE strasse"), (380, "İstanbul istanbul"),
    (420, "études études Etudes"), (460, "x⃝abcde abcde"), (500, "ǅungla Ǆungla"), (540, "ﬁnale finale"), (580, "tout ça"), (620, ""), (660, None), (700, "Ünique 12\U0001d11e34 end"), (7, "Other words"),
    (740, "twice, once"), (740, "12 other"), (780, "alone 99"), (780, "of a b"), (780, "- -- -"),
]


def test_aligned_forms_on_odd_texts(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = duck.execute(entry.oracle_sql()["aligned_forms"])
    names = [d[0] for d in found.description]
    mine = entry.queries()["aligned_forms"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, mine))) == sorted(map(repr, found.fetchall()))
