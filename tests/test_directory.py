"""Directory trees against a plain loop, and what of them a budget shows."""

import pytest

from corpuspack.operators.directory import directory_tree, sheets_of_page, shown_sheets

SCHEMA = "source string, page_id long, template_id string, fingerprint string, original_tokens_est long"


def plain(rows, fanout):
    out = {}
    for source in {r[0] for r in rows}:
        pages = sorted((r for r in rows if r[0] == source), key=lambda r: r[1])
        lines = [(p, p, 1, n, f'{{"page_id": {p}, "template_id": "{t}", "fingerprint": "{f}", "tokens_est": {n}}}') for _, p, t, f, n in pages]
        level = 0
        while True:
            above = []
            for node in range(0, len(lines), fanout):
                some = lines[node : node + fanout]
                first, last, n, tokens = some[0][0], some[-1][1], sum(x[2] for x in some), sum(x[3] for x in some)
                out[source, level, node // fanout] = (len(lines) <= fanout, first, last, n, tokens, "\n".join(x[4] for x in some))
                above.append((first, last, n, tokens, f'{{"sheet": "{level}/{node // fanout}", "pages": [{first}, {last}], "n_pages": {n}, "tokens_est": {tokens}}}'))
            if len(lines) <= fanout:
                break
            lines, level = above, level + 1
    return out


@pytest.fixture(scope="module")
def rows():
    sizes = {"a": 30, "b": 4, "c": 1, None: 17, "d": 5}
    return [(s, (i * 7919 - 3000) * (10**14 if s == "a" and i == 3 else 1), f"t{i % 3}", f'f{i}', i + 1) for s, n in sizes.items() for i in range(n)]


def test_tree_equals_a_plain_loop(spark, rows):
    got = directory_tree(spark.createDataFrame(rows, SCHEMA), ["source"], 4).collect()
    assert {(r.source, r.level, r.node): (r.root, r.first_page, r.last_page, r.n_pages, r.tokens_est, r.sheet) for r in got} == plain(rows, 4)
    assert len(got) == len(plain(rows, 4))


def test_sheets_are_shown_from_the_root_down(spark, rows):
    tree = directory_tree(spark.createDataFrame(rows, SCHEMA), ["source"], 4)
    for budget in (0, 120, 400, 1 << 40):
        shown = {}
        for r in shown_sheets(tree, ["source"], budget).collect():
            shown.setdefault(r.source, {})[r.level, r.node] = r.entry
        for source in {r[0] for r in rows}:
            want, spent = {}, 0
            for (s, level, node), sheet in sorted(((k, v) for k, v in plain(rows, 4).items() if k[0] == source), key=lambda x: (-x[0][1], x[0][2])):
                entry = f"<<<SHEET {level}/{node}>>>\n{sheet[-1]}"
                spent += len(entry) + 1
                if (spent + 3) // 4 > budget:
                    break
                want[level, node] = entry
            assert shown.get(source, {}) == want
            assert all((level + 1, node // 4) in want for level, node in want if not plain(rows, 4)[source, level, node][0])


def test_the_way_to_a_page(spark, rows):
    tree = directory_tree(spark.createDataFrame(rows, SCHEMA), ["source"], 4)
    page = sorted(r[1] for r in rows if r[0] == "a")[11]
    way = sheets_of_page(tree.where("source = 'a'"), page).orderBy("level").collect()
    assert [r.level for r in way] == [0, 1, 2] and f'"page_id": {page},' in way[0].sheet and way[-1].root


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert directory_tree(empty, ["source"], 4).isEmpty()
    null = spark.createDataFrame([("a", None, None, None, None), ("a", 1, "t", "f", 2), ("a", 1, "t", "f", 2)], SCHEMA)
    (sheet,) = directory_tree(null, ["source"], 4).collect()
    assert sheet.sheet.splitlines()[0] == '{"page_id": null, "template_id": null, "fingerprint": null, "tokens_est": null}' and sheet.n_pages == 3
    with pytest.raises(ValueError):
        directory_tree(empty, ["source"], 1)


def test_no_value_grows_with_the_scope(spark):
    many = spark.range(100_000).selectExpr("'s' AS source", "id AS page_id", "'0123456789abcdef' AS template_id", "'abc|def' AS fingerprint", "10L AS original_tokens_est")
    tree = directory_tree(many, ["source"], 256)
    got = tree.selectExpr("max(length(sheet)) AS longest", "max(level) AS level", "count_if(root) AS roots", "max(n_pages) AS n", "max(tokens_est) AS tokens").first()
    assert got.longest < 256 * 120 and (got.level, got.roots, got.n, got.tokens) == (2, 1, 100_000, 1_000_000)
    assert shown_sheets(tree, ["source"], 20_000).selectExpr("sum(length(entry) + 1) AS size").first().size <= 80_000
