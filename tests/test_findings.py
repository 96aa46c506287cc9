"""Inputs on which queries once differed from their SQL or did not do their whole job."""

import duckdb
import pytest

from tallyreef.functions import markup
from tallyreef.operators import searches
from tallyreef.plans import registry
from tests.compare import same
from tests.conftest import SF


@pytest.fixture
def folder(tmp_path):
    """Writes tables, given as SQL over those of the test data, and gives their folder with a connection to them."""

    def make(**tables):
        con = duckdb.connect()
        for name, sql in tables.items():
            con.sql(f"copy ({sql.format(**{name: f"'{SF}/{name}.parquet'"})}) to '{tmp_path}/{name}.parquet' (format parquet)")
            con.sql(f"create view {name} as from '{tmp_path}/{name}.parquet'")
        return str(tmp_path), con

    return make


def test_new_stores_with_keys_above_a_thousand(spark, folder):
    sf, con = folder(supplier="select s.* replace (s_suppkey + 500 * i as s_suppkey) from {supplier} s, range(6) t(i)")
    same(registry.QUERIES["new_stores"](spark, sf), con.sql(registry.ORACLE_SQL["new_stores"]))


#: Two sizes, 41 and 4, of one name: the first was once read as 4 and "1 BOX".
PARTS = "select p.* replace ('hot anvil' as p_name, 'LARGE' as p_type, (case p_partkey when 2 then 41 else 4 end)::int as p_size) from {part} p where p_partkey in (2, 4)"


def test_merge_outcomes_where_a_size_ends_in_one(spark, folder):
    sf, con = folder(part=PARTS)
    same(registry.QUERIES["merge_outcomes"](spark, sf), con.sql(registry.ORACLE_SQL["merge_outcomes"]))


def test_product_references_where_a_size_ends_in_one(spark, folder):
    sf, con = folder(part=PARTS)
    same(registry.QUERIES["product_references"](spark, sf), con.sql(registry.ORACLE_SQL["product_references"]))


def test_same_case_join_gives_each_row_with_its_classes(spark, sf):
    rows = [r.asDict() for r in registry.QUERIES["same_case_join"](spark, sf).collect()]
    suppliers, customers = ([r for r in rows if r["source"] == s] for s in ("supplier", "customer"))
    assert len(customers) == duckdb.sql(f"select * from '{sf}/customer.parquet'").shape[0]
    linked = lambda a, b: (a["nation"], a["band"]) == (b["nation"], b["band"]) or a["tail"] == b["tail"] != ""
    for some, others in ((suppliers, customers), (customers, suppliers)):
        for a in some:
            assert a["links"] == sum(linked(a, b) for b in others)


def test_explicit_ends_tell_all_wordings(spark):
    df = registry.QUERIES["explicit_ends"](spark, "/root/testdata/sf0.01")
    said = {r["ended"] for r in df.select("ended").distinct().collect()}
    assert {f"status={x}" for x in ("受付終了", "CLOSED", "キャンセル！", "※ 応募受付は終了しました。", "※ 応募受付は終了しました 5-LOW")} < said


def most_rows(df):
    """Most rows that an operator of the plan puts out."""

    def of(plan):
        plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan.plan() if "QueryStage" in plan.nodeName() else plan
        found = plan.metrics().get("numOutputRows")
        inner = plan.children()
        return max([found.get().value() if found.isDefined() else 0, *(of(inner.apply(i)) for i in range(inner.size()))])

    df.collect()
    return of(df._jdf.queryExecution().executedPlan())


def test_entity_match_ladder_lists_no_pairs(spark, folder):
    sf, con = folder(part="select p.* replace (50 * (p_partkey + 200 * i) as p_partkey, 'LARGE' as p_type) from {part} p, range(5) t(i)")
    df = registry.QUERIES["entity_match_ladder"](spark, sf)
    assert most_rows(df) < 50 * 1000
    same(df, con.sql(registry.ORACLE_SQL["entity_match_ladder"]))


def test_discoveries_are_not_shuffled_by_their_hash(spark, sf):
    plan = registry.QUERIES["discovery_merge_by_identity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert dealt and not any("identity" in line for line in dealt)


def test_text_dates_search_a_text_once_a_pattern(spark, sf):
    plan = registry.QUERIES["text_dates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 200  # 225 when each part of a date searched anew; most of the rest is read only where labels are missing


PAGE = """<!DOCTYPE html><title>t</title><A HREF='/x?a=1&amp;b' class=big>a &amp; b<br/></a><ul><li>one<li class="two">two</ul><p/>x<img alt="p &lt; q" src="/i.png" hidden>"""


def test_plain_markup_is_read_without_the_parser_and_alike(monkeypatch):
    odd = markup.lines_of(PAGE + "<!-- not plain -->")
    with monkeypatch.context() as m:
        m.setattr(markup.HTMLParser, "feed", None)
        assert markup.lines_of(PAGE) == odd
    for rest in ("<script>var h = '<p>no'</script>", "<a b = 'c'>x", "a < b", "<", "<p", "&#x", "<a href=/x/>y</a>"):
        assert markup.lines_of(PAGE + rest)[: len(odd) - 1] == odd[:-1]


def test_article_candidates_do_not_gather_lines_of_pages(spark, sf):
    plan = registry.QUERIES["article_candidates"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("ArrowEvalPython") == 1


def test_official_applications_do_not_gather_lines_of_pages(spark, sf):
    plan = registry.QUERIES["official_applications"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "EvalPythonUDTF" not in plan


def test_retail_search_ranks_many_offers_in_more_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(searches, "TASK_ROWS", 500)
    sf, con = folder(**{t: f"from {{{t}}}" for t in ("part", "supplier", "lineitem")})
    tasks = con.sql("select count(*) // 500 from lineitem").fetchall()[0][0]
    df = registry.QUERIES["retail_search"](spark, sf)
    dealt = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert tasks > 4 and dealt and all(f", {tasks})" in line for line in dealt)
    same(df, con.sql(registry.ORACLE_SQL["retail_search"]))


def test_conflict_split_works_out_forms_once(spark, sf):
    plan = registry.QUERIES["conflict_split"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_official_applications_read_and_search_a_page_once(spark, sf):
    plan = registry.QUERIES["official_applications"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # 3 passes of Python and 5 searches for the parts of each date before; what the filter asks for is searched once more.
    assert plan.count("ArrowEvalPython") == 1 and plan.count("当選発表|結果発表") <= 2 and plan.count("終了|締切") <= 4


def test_plain_pages_are_read_in_one_loop_and_alike(monkeypatch):
    def events(html):
        lines = markup.PageLines()
        markup.TagEvents(lines).read(html)
        lines._flush()
        return lines.rows

    rest = ("", "&amp; x > y", "<template>no</template>x", "<p><article>in<h2>Head</h2><a href='/y'>to<br>y<p>z</article>", "<a href='x'>open<td>b</tr>", "<div class='x content'>c</div></div>d<time datetime=1>", "<a b='<c>d'>x", "<script>'<p>'</script>", "</p", "<!-- c -->")
    pages = [part + end for part in ("", "text", PAGE, "<meta name=date content='2'>") for end in rest]
    alike = [events(page) for page in pages]
    assert [markup.lines_of(page) for page in pages] == alike
    with monkeypatch.context() as m:
        m.setattr(markup, "TagEvents", None)
        m.setattr(markup, "KNOWN_TAGS", 3)
        assert [markup.lines_of(PAGE + end) for end in rest[:6]] == [events_of for page, events_of in zip(pages, alike, strict=True) if page in [PAGE + end for end in rest[:6]]]
