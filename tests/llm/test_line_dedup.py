"""Site-relative line dedup by hand and against its SQL."""

import duckdb

from foliospark.llm import line_dedup as L


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, HOST string, n_lines int")


def test_boilerplate_goes_and_the_rest_stays(spark):
    menu = "<nav><ul><li>Home</li><li>About</li></ul></nav>"
    rows = [(i, f"https://User@Site.example:80/{i}", f"{menu}<script>x<y</script><p>Text &amp; words {i}</p><p>twice</p><p>twice</p><!-- <p>no</p> -->", "x", 0) for i in range(20)]
    rows += [(100 + i, "http://other.example/", f"{menu}<p>Only here {i}</p>", "x", 0) for i in range(2)]
    got = {r.page_id: r for r in L.drop_boilerplate(pages(spark, rows)).collect()}
    assert got[3].text == "Text & words 3" and got[3].host == "site.example" and (got[3].n_lines, got[3].n_dropped) == (5, 4)
    assert got[100].text == "Only here 0"


def test_a_lone_page_keeps_all_and_each_page_asks_the_others(spark):
    rows = [(1, "http://lone/", "<p>a</p><p>b</p>", "x", 0)] + [(10 + i, "http://pair/", f"<p>both</p><p>own {i}</p>", "x", 0) for i in range(2)]
    rows += [(20 + i, "http://ten/", f"<p>own {i}</p>" + ("<p>two</p>" if i < 2 else "") + ("<p>three</p>" if i < 3 else ""), "x", 0) for i in range(11)]
    got = {r.page_id: r.text for r in L.drop_boilerplate(pages(spark, rows)).collect()}
    assert got[1] == "a\nb" and got[10] == "own 0" and got[20] == "own 0\ntwo" and got[30] == "own 10"


def test_rough_pages(spark):
    rows = [(1, None, "<p>a</p>", None, None), (2, "not a url", None, None, None), (None, "http://h/", "", "y", 1), (4, "http://h/", "<p>" + "long text " * 100_000 + "</p>", "y", 1), (4, "http://h/", "<p>unclosed", "y", 1), (4, "http://h/", "<p>unclosed", "y", 1)]
    got = sorted(L.drop_boilerplate(pages(spark, rows)).collect(), key=str)
    assert len(got) == 6 and sum(r.n_lines for r in got) == 4 and sorted(r.n_dropped for r in got) == [0, 0, 0, 0, 1, 1]  # "unclosed" is on a third of the other pages
    assert {r.host for r in got} == {"", "h"}
    assert L.drop_boilerplate(pages(spark, [])).collect() == []


def test_a_ratio_met_exactly_doesnt_drop(spark):
    rows = [(i, "http://h/", f"<p>own {i}</p>" + ("<p>some</p>" if i < 4 else ""), "x", 0) for i in range(7)]
    assert sum(r.n_dropped for r in L.drop_boilerplate(pages(spark, rows), ratio=0.5).collect()) == 0
    assert sum(r.n_dropped for r in L.drop_boilerplate(pages(spark, rows), ratio=0.49).collect()) == 4


def test_whole_table_equals_the_sql(spark):
    duckdb.execute("create or replace view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    want = sorted(map(str, duckdb.execute(f"select page_id, host, n_lines, n_dropped, text from ({L.ORACLE_SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in L.query(spark, "/root/testdata/sf0.01").collect()) == want
