"""Queries over whole tables, without the subsets that their namesakes share with SQL, against plain loops."""

from __future__ import annotations

import unicodedata
from collections import Counter

from larkspur.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_scores_of_texts_in_any_script(spark, tmp_path):
    texts = [None, "", " \n", "plain text", "é", "Grüße aus Köln, déjà vu", "a\u00a0b c", "bad \ufffd \u200b text", "\x00\x01\x02", "Straße " * 40, "漢字"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text in enumerate(texts):
        seen = [c for c in (text or "").strip() if not c.isspace()]
        odd = sum(not c.isprintable() for c in seen)
        suspicious = sum(c == "\ufffd" or unicodedata.category(c).startswith("C") for c in seen)
        n = max(1, len(seen))
        score = 0.85 * 65 + (1 - odd / n) * 20 + min(10, len(seen) / 4) + (1 - suspicious / n) * 5 if seen else 0.0
        want[i] = round(score, 4)
    assert {r["doc_id"]: round(r["score"], 4) for r in catalogue.QUERIES["ocr_text_score_all"](spark, str(tmp_path)).collect()} == want


def test_lines_in_any_script(spark, tmp_path):
    rows = [*map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()), (10**6, "ÉTÉ à Zürich\nx"), (10**6 + 1, " été À ZÜRICH \ny")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    count, first = Counter(), {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            plain = line.strip(" ")
            if plain and len(plain) <= 120 and not any(c in "0123456789=" for c in line):
                key = plain.lower()
                count[key] += 1
                first[key] = min(doc_id, first.get(key, doc_id))
    want = {k: (n, first[k]) for k, n in count.items() if n > 1}
    assert want["été à zürich"] == (2, 10**6)
    assert {r["key"]: (r["n"], r["first"]) for r in catalogue.QUERIES["line_frequency_all"](spark, str(tmp_path)).collect()} == want


def test_the_whole_list_is_matched(spark, tmp_path):
    spark.createDataFrame([(i, f"Customer#{i:09d}") for i in range(100)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, f"Supplier#{i:09d}") for i in range(60)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {r["c_custkey"]: r["hits"] for r in catalogue.QUERIES["normalised_name_match_all"](spark, str(tmp_path)).collect()} == {i: str(i) for i in range(60)}
