"""Reading files of different column orders, and texts that models return."""

import pytest
from pyspark.sql import functions as F

from synchrony.sources import tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def test_csv_columns_are_found_by_name(spark, tmp_path):
    write(tmp_path / "v1" / "segments.csv", 'segment_id,text,start_time,end_time,n_words\n1,"a, ""b""\nc",0.5,2,3\n2,nan,,NaN,\n')
    write(tmp_path / "v2" / "segments.csv", "﻿n_words,segment_id,end_time,start_time,text\r\n7,5,9.0,8.0,last\r\n")
    write(tmp_path / "v3" / "segments.csv", 'extra,"text",segment_id\nx,only,9\n')
    write(tmp_path / "v4" / "segments.csv", "segment_id,text,start_time,end_time,n_words\n")
    rows = {(r.video_id, r.segment_id): tuple(r)[2:] for r in tables.read_table(spark, "segments", f"{tmp_path}/*/segments.csv").collect()}
    assert rows == {("v1", 1): ('a, "b"\nc', 0.5, 2.0, 3), ("v1", 2): (None, None, None, None), ("v2", 5): ("last", 8.0, 9.0, 7), ("v3", 9): ("only", None, None, None)}


def test_parquet_files_of_different_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "segment_id long, text string").write.parquet(f"{tmp_path}/x.parquet")
    spark.createDataFrame([("b", 2, 1.5)], "text string, segment_id long, start_time double").write.mode("append").parquet(f"{tmp_path}/x.parquet")
    rows = tables.read_table(spark, "segments", f"{tmp_path}/x.parquet", r"([^/]+)\.parquet/[^/]+$").collect()
    assert sorted((r.video_id, r.segment_id, r.text, r.start_time) for r in rows) == [("x", 1, "a", None), ("x", 2, "b", 1.5)]


def one(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


CONCEPTS = [
    ('Sure: ["Hash Table", " heap "]', ["hash table", "heap"]),
    ('["a", "B", ""] and more', ["a", "b"]),
    ('[1, null, true, "x]y"]', ["1", "none", "true", "x]y"]),
    ('- "Stack"\n* queue, • Tree\n1. list\nx\n\n', ['"stack', "queue", "tree", "1. list"]),
    ('["a"] or ["b"]', ['["a"] or ["b"]']),
    ("['single', 'quotes']", ["['single", "quotes']"]),
    ("[not json, at all]", ["[not json", "at all]"]),
    ("[]", []),
    ("", []),
    (None, []),
    ("ab", ["ab"]),
]


def test_concepts(spark):
    assert one(spark, tables.parse_concepts, [x for x, _ in CONCEPTS]) == [y for _, y in CONCEPTS]


LONG = "\n".join(["x", "- first useful line", "ok", "• second useful line", "y" * 160, *[f"line number {i}" for i in range(9)]])
DESCRIPTIONS = [
    ("  NON-CONTENT ", "NON_CONTENT"),
    ("This is Non_Content here", "NON_CONTENT"),
    ("I cannot see it", "NON_CONTENT"),
    ("A channel logo", "NON_CONTENT"),
    ("A channel logo " + "and more " * 12, ("A channel logo " + "and more " * 12).strip()),
    ("Here are the key terms: hash table, heap", "hash table, heap"),
    ("Well. In this frame, the terms: are these: stack, queue", "are these: stack, queue"),
    ("Key terms: a - b", "Key terms: a - b"),
    ("The frame shows what is meant by a stack", "meant by a stack"),
    ('"The image shows: a tree."', "The image shows: a tree."),
    ('"The image shows a tree."', "a tree"),
    ("The text reads 'hello there'", "hello there"),
    ("The image is a stack", "The image is a stack"),
    ("The primary concept being explained in this very long sentence that goes on is: recursion", "The primary concept being explained in this very long sentence that goes on is: recursion"),
    (LONG, "first useful line; second useful line; line number 0; line number 1; line number 2"),
    ("title slide of a talk", "title slide of a talk"),
    ("''", "''"),
    ("", ""),
    (None, None),
]


def plain_description(raw):
    """The same by plain string operations."""
    text = raw.strip()
    low = text.lower()
    if tables.NON_CONTENT in text.upper().replace("NON-CONTENT", "NON_CONTENT") or any(x in low for x in tables.REFUSALS) or (len(text) < 80 and any(x in low for x in tables.SHORT_ONLY)):
        return tables.NON_CONTENT
    out = text
    for opening in tables.OPENINGS:
        at = out.lower().find(opening)
        rest = out[at + len(opening) :]
        near = [s for s in tables.SEPARATORS if 0 <= rest.find(s) < 30] if at >= 0 else []
        if near:
            found = rest[rest.find(near[0]) + len(near[0]) :].strip()
            out = found if len(found) > 5 else out
    out = out.strip("\"'")
    for starter in tables.STARTERS:
        if out.lower().startswith(starter):
            rest = out[len(starter) :]
            verb = next((v for v in tables.VERBS if rest.lower().startswith(v)), None)
            out = out if verb is None else rest[len(verb) :].strip("\"'.:- ")
    if len(out) > 250:
        useful = [x.strip().strip("-•*").strip() for x in out.split("\n") if 5 < len(x.strip()) < 150]
        out = "; ".join(useful[:5]) if useful else out
    return out or text


def test_descriptions(spark):
    assert one(spark, tables.clean_description, [x for x, _ in DESCRIPTIONS]) == [y for _, y in DESCRIPTIONS]
    assert [None if x is None else plain_description(x) for x, _ in DESCRIPTIONS] == [y for _, y in DESCRIPTIONS]


def test_descriptions_by_plain_strings(spark):
    import random

    rng = random.Random(9)
    bits = [*tables.OPENINGS, *tables.STARTERS, *tables.VERBS, *tables.SEPARATORS, "a stack", "The Heap", '"', "'", "\n", " ", "- ", "• item of a list", "x" * 60, "no more words here"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    assert one(spark, tables.clean_description, texts) == [plain_description(t) for t in texts]


@pytest.mark.parametrize("n", [1, 3])
def test_transcript_is_shared_with_every_target(spark, n):
    words = spark.createDataFrame([("a", i, f"w{i}") for i in range(50)] + [("b", 0, "other")], "video_id string, word_id long, word string")
    targets = spark.createDataFrame([(f"t{i}",) for i in range(n)], "video_id string")
    out = tables.share_transcript(words, "a", targets)
    assert out.count() == 50 * n and out.distinct().count() == 50 * n
