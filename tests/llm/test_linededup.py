import random

import pytest

from offerlake.llm import linededup as L


def brute(rows, least=L.MIN_WORDS):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        kept, gone = [], 0
        for line in text.split("\n"):
            if len(line.split()) >= least and line.strip(" ") in seen:
                gone += 1
                continue
            if len(line.split()) >= least:
                seen.add(line.strip(" "))
            kept.append(line)
        out[doc] = ("\n".join(kept), gone)
    return out


@pytest.mark.parametrize("bits", [None, 1 << 20])
def test_against_brute_force(documents, bits):
    rng = random.Random(7)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    rows = [(i, "\n".join(rng.choice(["", " ", "  "]) + rng.choice(lines) + rng.choice(["", " "]) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    rng.shuffle(rows)
    out = L.dedup_lines(documents(rows).repartition(5), bits=bits)
    assert {r["doc_id"]: (r["text"], r["lines_dropped"]) for r in out.collect()} == brute(rows)


def test_a_passage_shared_by_many_stays_once(documents):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own line number {i} of this\n{passage}\n") for i in range(40)]
    out = {r["doc_id"]: r["text"] for r in L.dedup_lines(documents(rows).repartition(7)).collect()}
    assert out[0] == rows[0][1] and all(out[i] == f"own line number {i} of this\n" for i in range(1, 40))


def test_lines_seen_in_two_tasks_are_in_the_filter(spark, documents):
    rows = [f"unique line of number {i}" for i in range(500)] + ["a line that comes twice"] * 2
    table = L.twice_seen(documents(rows).repartition(6), 1 << 20)
    import numpy as np

    full = np.unpackbits(table, bitorder="little")
    assert 0 < full.sum() <= 2 * L.PROBES + 3


def test_awkward_rows(awkward, nothing):
    out = L.dedup_lines(awkward)
    assert out.columns == [c for c in awkward.columns if c not in ("row_key", "lines_dropped")] + ["lines_dropped"]
    rows = out.collect()
    assert len(rows) == awkward.count()
    by = {(r["doc_id"], r["n"]): r for r in rows}
    assert [r["lines_dropped"] for r in rows if r["doc_id"] == 1] == [0, 0]  # repeated rows are one document
    assert by[6, 7]["text"] == "" and by[6, 7]["lines_dropped"] == 1
    assert by[2, None]["text"] is None and by[3, 0]["text"] == "" and by[4, 0]["text"] == " \n\t\n "
    assert L.dedup_lines(awkward, drop_emptied=True).filter("doc_id = 6").count() == 0
    assert L.dedup_lines(awkward, drop_emptied=True).count() == awkward.count() - 1
    assert L.dedup_lines(nothing).count() == 0


def test_short_lines_and_unspaced_scripts_stay(documents):
    left = ["apples\npears\nplums", "two words", "这是一个没有空格的段落。", "ประโยคนี้ไม่มีช่องว่าง"]
    rows = ["the footer of every page", *[f"the footer of every page\n{t}" for t in left], "the footer of every page"]
    kept = L.dedup_lines(documents(rows), drop_emptied=True).orderBy("doc_id").collect()
    assert [r["text"] for r in kept] == [rows[0], *left]


def test_scraps_go_with_their_document(documents):
    rows = ["the first line of it\nLes.", "the first line of it\nUn.", "the first line of it\nUn. and more to keep", "Les."]
    kept = L.dedup_lines(documents(rows), drop_emptied=True).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(0, rows[0]), (2, "Un. and more to keep"), (3, "Les.")]
