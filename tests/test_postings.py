"""Posting lists against a scan of the texts: a term is named once a run of documents, and merged lists hold the same postings."""

import re

from tessera.operators import postings as P
from tessera.operators import search, segments

TEXTS = {1: "Alpha beta alpha", 2: None, 3: "é-beta_2 ALPHA", 4: "", 5: "alpha " * 50} | {k: "alpha word" for k in range(10, 200)}


def frame(spark):
    return spark.createDataFrame(list(TEXTS.items()), "key bigint, text string").coalesce(1)


def expected():
    out = set()
    for k, t in TEXTS.items():
        w = [x.lower() for x in re.findall(P.TOKEN, t or "")]
        out |= {(k, len(w), x, w.count(x), tuple(i for i, y in enumerate(w) if y == x)) for x in set(w)} if w else {(k, 0, None, 0, ())}
    return out


def rows(df):
    found = [(r.key, r.len, r.term, r.tf, tuple(r.positions)) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_lists_hold_all_postings_and_name_a_term_once(spark):
    lists = P.posting_lists(frame(spark), "bigint", ("text",), positions=True)
    assert rows(P.unpacked(lists, positions=True)) == expected()
    assert lists.where("term = 'alpha'").count() == 1 and lists.where("term is null").count() == 1  # one task, one run
    merged = P.merged_lists(P.unpacked(lists, positions=True).repartition(2).coalesce(1), "bigint")
    assert rows(P.unpacked(merged, positions=True)) == expected() and merged.where("term = 'alpha'").count() == 1


def test_stored_rows_of_both_indexes_do_not_grow_with_documents(spark, tmp_path):
    index = segments.SegmentIndex(spark, str(tmp_path / "segments"), ("text",))
    index.update(frame(spark))
    stored = spark.read.parquet(f"{tmp_path}/segments/data/{next(iter(index.at.facts['segments'].values()))}")
    assert stored.where("term = 'alpha'").count() == 1 and rows(index.postings()) == expected()
    fresh = search.Index.write(frame(spark), "key", ("text",), str(tmp_path / "fresh"))
    assert spark.read.parquet(f"{tmp_path}/fresh/postings").where("term = 'alpha'").count() == 1
    assert {(r.key, r.len, r.term, r.tf) for r in fresh.postings().collect()} == {x[:4] for x in expected()}


def test_checks_of_changes_move_no_text(spark):
    files = spark.createDataFrame([(1, "h", 1, 1, "words")], "key bigint, content_hash string, mtime bigint, size bigint, text string")
    pending = spark.createDataFrame([(1, "UPSERT", 1, "h", 1, 1)], "change_id bigint, change_type string, key bigint, content_hash string, mtime bigint, size bigint")
    plan = segments.checked_changes(pending, files).select("change_id", "action")._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    assert "now_size" in join and "now_text" not in join
