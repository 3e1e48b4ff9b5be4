"""Decontamination against a search of all runs of words."""

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import decontaminate as D

LONG_ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def words(text):
    return regex.findall(r"[\p{L}\p{N}\p{M}]+", text.lower())  # of texts without unspaced scripts


def brute(text, items, limit, coverage, least):
    """The words that go: those in any run that is in an item and is long enough, or covers enough of it."""
    own, gone = words(text), set()
    for item in items:
        if not item:
            continue
        for i in range(len(own)):
            for j in range(len(item)):
                n = 0
                while i + n < len(own) and j + n < len(item) and own[i + n] == item[j + n]:
                    n += 1
                    if n >= limit or (len(item) >= least and n >= coverage * len(item)):
                        gone |= set(range(i, i + n))
    return gone


WORDS = st.lists(st.sampled_from("abc"), max_size=24)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=4), WORDS, st.integers(2, 6), st.sampled_from([0.5, 0.8, 1.0]))
def test_spans_are_those_of_brute_force(items, text, limit, coverage):
    import numpy as np

    code = {"a": 11, "b": 22, "c": 33}
    own = D.Matcher([[code[w] for w in x] for x in items if x], limit, coverage, 3)
    found, longest = own.spans(np.zeros(len(text), np.int64), np.array([code[w] for w in text], np.uint64), 1)
    gone = {i for a, b in found.get(0, []) for i in range(a, b)}
    assert gone == brute(" ".join(text), items, limit, coverage, 3)
    every = [n for n in range(1, len(text) + 1) for i in range(len(text) - n + 1) if any(text[i : i + n] == x[j : j + n] for x in items for j in range(len(x) - n + 1))]
    assert longest.tolist() == [max(every, default=0)]


def test_many_automata_find_what_one_does(monkeypatch):
    import numpy as np

    items = [[i, i + 1, i + 2, i + 3, i + 4] for i in range(1, 60, 2)]
    text = np.arange(1, 50).astype(np.uint64)
    one = D.Matcher(items, 4, 0.9, 3).spans(np.zeros(49, np.int64), text, 1)
    monkeypatch.setattr(D, "AUTOMATON_WORDS", 12)
    many = D.Matcher(items, 4, 0.9, 3)
    assert len(many.automata) > 5 and many.spans(np.zeros(49, np.int64), text, 1)[0] == one[0]


def test_rough_rows_and_clean_text(spark, rough, none):
    items = spark.createDataFrame([(1, LONG_ITEM), (2, None), (3, ""), (4, LONG_ITEM), (5, "the sea, the wind AND the boats")], "item_id bigint, text string")
    docs = spark.createDataFrame([(20, f"Before. {LONG_ITEM.upper()}! After.", "en", "a", 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    row = D.decontaminate(docs, items).first()
    assert (row.text, row.n_words, row.n_removed, row.longest) == ("Before. ! After.", 14, 12, 12)
    got = D.decontaminate(rough, items).collect()
    assert [r["n_removed"] for r in got] == [7, 7, 0, 0, 0, 0, 0, 0, 0]
    assert got[0][1] == "One plain text about .\nIt has a second line."
    assert got[6][1] == rough.collect()[6][1]
    assert D.decontaminate(none, items).collect() == []
    assert all(r["n_removed"] == 0 for r in D.decontaminate(rough, items.limit(0)).collect())


def test_stage_keeps_columns_and_drops_what_is_all_benchmark(spark, rough):
    items = spark.createDataFrame([(1, LONG_ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, LONG_ITEM, 70), (2, f"Some words. {LONG_ITEM}", 80), (3, "clean", 5), (4, None, None)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in D.stage(docs, items).collect()}
    assert got == {2: ("Some words. ", 12), 3: ("clean", 5), 4: (None, None)}
    assert D.stage(rough, items).columns == [c for c in rough.columns if c != "n_words"]


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    runs = {tuple(x[i : i + D.LENGTH_LIMIT]) for x in items for i in range(len(x) - D.LENGTH_LIMIT + 1)}
    assert min(map(len, items)) * D.COVERAGE_LIMIT >= D.LENGTH_LIMIT  # so the length decides here
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = words(r.text)
        gone = {j for i in range(len(own)) if tuple(own[i : i + D.LENGTH_LIMIT]) in runs for j in range(i, i + D.LENGTH_LIMIT)}
        if gone:
            want[r.doc_id] = len(gone)
    got = D.query(spark, sf).collect()
    assert len(got) == 200 and {r.doc_id: r.n_removed for r in got if r.n_removed} == want


def test_whole_table_equals_the_sql(spark):
    import duckdb

    for t in ("documents", "benchmark"):
        duckdb.execute(f"create or replace view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = sorted(duckdb.execute(D.ORACLE_SQL).fetchall())
    assert want and sorted(tuple(r) for r in D.query(spark, "/root/testdata/sf0.001").collect()) == want


def test_short_items_go_as_whole_lines(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "Forty two."), (3, LONG_ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Yes, of course\nyes!\nForty two\nforty two or so\nend"), (2, "YES"), (3, "no")], "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_removed, r.longest) for r in D.decontaminate(docs, items).collect()}
    assert got == {1: ("Yes, of course\n\nforty two or so\nend", 3, 2), 2: ("", 1, 1), 3: ("no", 0, 0)}


def test_unspaced_scripts_go_by_character(spark):
    items = spark.createDataFrame([(1, "東京都は日本の首都であり、最大の都市である")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "彼は言った：東京都は日本の首都であり、最大の都市であると。ก12 word"), (2, "東京は遠い")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in D.decontaminate(docs, items).collect()}
    assert got[1].text == "彼は言った：と。ก12 word" and got[1].n_removed == 20 and got[1].n_words == 5 + 20 + 1 + 3
    assert got[2].n_removed == 0 and got[2].longest == 2


def test_a_large_benchmark_takes_passes_with_the_same_result(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    one = sorted(map(str, D.query(spark, sf).collect()))
    monkeypatch.setattr(D, "PASS_WORDS", 1500)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert len(list(D.matchers(items))) > 2 and sorted(map(str, D.query(spark, sf).collect())) == one


def test_the_matcher_is_as_small_as_it_says():
    import numpy as np

    rng = np.random.default_rng(1)
    items = [rng.integers(0, 1 << 62, 40).tolist() for _ in range(2500)]
    assert D.Matcher(items, D.LENGTH_LIMIT, D.COVERAGE_LIMIT, D.LEAST_ITEM).nbytes < 260 * 100_000


def test_the_sql_knows_short_items_and_nulls(spark):
    import duckdb

    docs = [(1, "Yes, of course\nyes!\nForty two\nend"), (2, None), (3, ""), (4, f"a {LONG_ITEM} b"), (5, "alpha beta x gamma delta epsilon"), (6, "東京都は日本の首都であ")]
    items = [(1, "Yes"), (2, "Forty two."), (3, LONG_ITEM), (4, None), (5, "東京都は日本の首都であり")]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    want = sorted(con.execute(D.ORACLE_SQL).fetchall())
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.longest, len(r.spans), ",".join(f"{s.first}-{s.last}" for s in r.spans), r.text) for r in got) == want
