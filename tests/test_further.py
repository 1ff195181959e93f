"""What the queries of the catalogue don't reach: damaged files, writers that meet, files on disk, the command line over a store."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_store import A, B, files, store  # noqa: F401
from test_units import BOOK

from folioscan import cli
from folioscan.operators import chunking, evidence, lexical, postings
from folioscan.operators.normalise import normalise_table
from folioscan.operators.search import payload, search
from folioscan.operators.store import Options, Store, StoreError
from folioscan.sources import docsite, manifest, units
from folioscan.sources.doctables import TableError, read_grid


def test_one_damaged_file_does_not_end_a_sync(spark, store):  # noqa: F811
    damaged = bytearray(BOOK)
    at = damaged.index(b"xl/worksheets/one.xml") + 40
    damaged[at : at + 30] = os.urandom(30)
    rows = [("a.md", bytearray(A.encode())), ("bad.xlsx", damaged), ("worse.xlsx", bytearray(BOOK[:300])), ("good.xlsx", bytearray(BOOK))]
    r = store.sync(spark.createDataFrame(rows, "path string, content binary"))
    assert r.failed >= 1 and "a.md" in [x["path"] for x in store.sources().collect()] and "good.xlsx" in [x["path"] for x in store.sources().collect()]
    assert {x["path"] for x in store.failures(r).collect()} == {e.split(":")[0] for e in r.errors} >= {"worse.xlsx"}


def test_of_two_writers_the_later_fails_and_nothing_is_lost(spark, store):  # noqa: F811
    store.sync(files(spark, a=A))
    one, other = Store(spark, store.root), Store(spark, store.root)
    one.sync(files(spark, a=A, b=B))
    with pytest.raises(StoreError):
        other.sync(files(spark, a=A, c=B + " more"))
    now = Store(spark, store.root)
    assert sorted(r["path"] for r in now.sources().collect()) == ["a.md", "b.md"] and now.state["number"] == 2
    assert not [n for n in os.listdir(store.root.removeprefix("file://") + "/versions") if n.startswith(".") and not n.endswith(".crc")]


def test_a_file_that_changes_while_it_is_read_is_not_taken_in(spark, store, monkeypatch):  # noqa: F811
    parse = units.parse_files
    monkeypatch.setattr("folioscan.operators.store.U.parse_files", lambda f: parse(f.withColumn("content", F.concat("content", F.lit(" x").cast("binary")))))
    r = store.sync(files(spark, a=A))
    assert r.failed == 1 and "changed" in r.errors[0] and store.sources().count() == 0


def test_a_sync_without_news_reads_no_chunk(spark, store, monkeypatch):  # noqa: F811
    store.sync(files(spark, a=A, b=B))
    read = []
    chunks = Store.chunks
    monkeypatch.setattr(Store, "chunks", lambda s: read.append(1) or chunks(s))
    assert store.sync(files(spark, a=A, b=B)).unchanged == 2 and len(read) == 1  # named in the plan of changed sources, of which there are none


def test_pages_quotes_and_counts_on_the_command_line(spark, store, capsys):  # noqa: F811
    store.sync(files(spark, a=A, b=B))
    at = ["--store", store.root]
    assert cli.main(["page", *at, "a.md"]) == 0 and capsys.readouterr().out == A + "\n"
    assert cli.main(["page", *at, "a.md", "1", "--format", "json"]) == 0
    row = json.loads(capsys.readouterr().out)[0]
    assert (row["source_path"], row["physical_page"], row["text"], row["pdf_link"]) == ("a.md", 1, A, None)
    assert cli.main(["page", *at, "a.md", "2"]) == 1 and cli.main(["page", *at, "a.md", "x"]) == 2 and cli.main(["page", *at, "none.md"]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["page", *at, "../x.md"])
    assert e.value.code == 2
    capsys.readouterr()
    for quote, status, code in (("Batteries store energy", "exact", 0), ("Batteries  store\nenergy", "normalised", 0), ("Batteries lose energy", "not-found", 1), (" ", "structural-error", 1)):
        assert cli.main(["quote", *at, "a.md", "1", quote]) == code and json.loads(capsys.readouterr().out)["status"] == status
    assert cli.main(["diagnose", *at]) == 0 and json.loads(capsys.readouterr().out)["rows"]["sources"] == 2
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_search_rows_as_nested_output(spark, store):  # noqa: F811
    store.sync(files(spark, a=A, b=B))
    found = search(store, "coal", limit=2)
    row = payload(found, store.sources().select("path", "sha256")).filter("rank = 1").first()
    assert row["source_path"] == "a.md" and row["provenance"] == ["lexical", "vector"] and row["line_range"]["start"] >= 1 and row["pdf_link"] is None
    pdf = found.withColumn("source_type", F.lit("pdf")).withColumn("page", F.lit(3))
    images = spark.createDataFrame([("a.md", 3, "page-render", "imgs/1.png"), ("a.md", 3, "figure-crop", "imgs/2.png")], "path string, page int, asset_type string, asset_path string")
    row = payload(pdf, store.sources().select("path", "sha256"), images).filter("source_path = 'a.md'").first()
    assert (row["pdf_link"], row["page_render"], row["figure_crops"]) == ("a.md#page=3", "imgs/1.png", ["imgs/2.png"])


TEXTS = ["the price of coal", "coal price may fall", "price of gas and price of coal", "", "may", "coal coal coal price", "off price ofx coal"]
ASKED = ["price", "coal price", "price NOT (price AND may)", "price NOT may", '"price of"', "pri*", "^price", "NEAR(coal price, 1)", "NEAR(coal price, 0)", "(gas OR may) AND price", "of-the", "nothing"]


def test_postings_give_what_the_texts_give(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    index, stats = postings.build(docs), postings.statistics(docs)
    for q in ASKED:
        want = sorted((r["doc_id"], round(r["score"], 9)) for r in lexical.bm25(docs, q).collect())
        assert sorted((r["doc_id"], round(r["score"], 9)) for r in postings.bm25(index, stats, q).collect()) == want, q
    some = docs.filter("doc_id < 3").select("doc_id")
    assert {r["doc_id"] for r in postings.bm25(index, stats, "price", allowed=some).collect()} == {0, 1, 2}


def test_near_against_every_place(spark):
    r = random.Random(4)
    texts = [r.choices("abcd", k=12) for _ in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    q = lexical.parse("NEAR(a b, 1)")
    want = [sum(t[i] in "ab" and {"a", "b"} <= set(t[i : i + 3]) for i in range(12)) for t in texts]
    counted = docs.select("doc_id", lexical.tokens(F.col("text")).alias("t")).select("doc_id", lexical._frequency(q).alias("n"))
    assert [x["n"] for x in counted.orderBy("doc_id").collect()] == want


def test_fold_against_its_definition():
    r = random.Random(7)
    for _ in range(200):
        sizes = [r.randint(0, 60) for _ in range(r.randint(0, 30))]
        sections = [r.choice("ab") for _ in sizes]
        want, used = [], 0
        for i, n in enumerate(sizes):
            if not want or used + n > 100 or sections[i] != sections[i - 1]:
                want.append([])
                used = 0
            want[-1].append(i)
            used += n + 2
        got = chunking.fold(sizes, sections, 100)
        assert [list(range(g["start"], g["start"] + g["n"])) for g in got] == want
        assert all(g["at"] == sum(sizes[: g["start"]]) + 2 * g["start"] and g["span"] == sum(sizes[i] + 2 for i in w) - 2 for g, w in zip(got, want))


def test_quotes_in_blocks(spark):
    docs = spark.createDataFrame([(i, f"text {i} says a word of number {i % 5} here") for i in range(30)], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(k, f"a word of number {k} here") for k in range(5)], "quote_id bigint, quote string")
    whole = sorted(map(tuple, evidence.find_quotes(quotes, docs).collect()))
    assert len(whole) == 30 and whole == sorted(map(tuple, evidence.find_quotes(quotes, docs, most_bytes=60).collect()))


GRID = "+-----+-----+\n| A   | B   |\n+=====+=====+\n| 1   | 2   |\n|     +-----+\n|     | 3   |\n+-----+-----+\n| all       |\n+===========+\n"


def test_grid_tables_with_spans():
    p = read_grid(GRID)
    assert p.headers == ["A", "B"] and p.rows == [["1", "2"], ["1", "3"], ["all", "all"]]
    assert [d.code for d in p.diagnostics].count("table.span-expanded") == 2
    with pytest.raises(TableError):
        read_grid(GRID.replace("| 1   | 2   |", "| 1   | 2  |"))


def test_fallback_and_kind():
    bare = "```\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n"
    with pytest.raises(TableError):
        normalise_table(bare)
    t = normalise_table(bare, pipe_fallback=True)
    assert t.rows == [["1", "2"]] and "table.pipe-fallback" in {d.code for d in t.diagnostics}
    both = "| a |\n|---|\n| 1 |\n\n<table><tr><th>x</th></tr><tr><td>2</td></tr></table>\n"
    assert normalise_table(both, kind="html").rows == [["2"]] and normalise_table(both, kind="markdown").rows == [["1"]]


CONTRACT = 'schema_version = 1\n[docs]\nauthored_root = "docs"\nretained_root = "docs"\nstaged_root = "staged"\nsource_links = "links.toml"\nindex_output = "index/db"\npublication_exclude = ["docs/draft"]\n'


def test_contracts(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text(CONTRACT)
    c = docsite.contract(p)
    assert (c.retained_root, c.publication_exclude, c.render_command) == ("docs", ("docs/draft",), None)
    for old, new in (('"staged"', '"docs/staged"'), ("schema_version = 1", "schema_version = 2"), ('"links.toml"', '"../links.toml"'), ('index_output = "index/db"\n', ""), ("[docs]", "[docs]\nodd = 1"), ('retained_root = "docs"', 'retained_root = "docs/r"')):
        p.write_text(CONTRACT.replace(old, new))
        with pytest.raises(docsite.ContractError):
            docsite.contract(p)


def test_build_variants():
    v = docsite.build_variant
    assert v(set()) == "prose" and v({"python"}) == "python" and v({"python", "julia"}, julia=True) == "combined"
    assert v({"python", "julia"}, overlays=["python"]) == "python" and v({"python", "julia"}, "julia", True, ["julia"]) == "julia"
    for bad in (lambda: v({"julia"}), lambda: v({"python"}, "julia"), lambda: v({"python", "julia"}), lambda: v({"python", "julia"}, "python")):
        with pytest.raises(docsite.ContractError):
            bad()


def test_a_mirror_replaces_the_tree_in_one_step(spark, tmp_path):
    root = str(tmp_path / "out")
    docs = spark.createDataFrame([("a.md", "one"), ("sub/b.md", "two\n")], "path string, text string")
    assert docsite.mirror(docs, root) == 2
    assert docsite.mirror(docs.filter("path = 'a.md'").withColumn("text", F.lit("new")), root) == 1
    assert sorted(os.listdir(tmp_path)) == ["out"] and (tmp_path / "out" / "a.md").read_text() == "new"
    with pytest.raises(docsite.ContractError):
        docsite.mirror(docs.union(spark.createDataFrame([("../x", "")], "path string, text string")), root)
    assert (tmp_path / "out" / "a.md").read_text() == "new"


def test_manifests_and_discovery(spark, tmp_path):
    m = tmp_path / "m.toml"
    m.write_text('schema_version = 1\n[[source]]\npath = "a.md"\n[[include]]\nglob = "sub/*"\norigin = "shared"\n[[exclude]]\nglob = "*draft*"\n')
    r = manifest.load(m)
    assert (r.explicit, r.include, r.exclude, r.origins["sub/*"]) == (["a.md"], ["sub/*"], ["*draft*"], "shared")
    for bad in ('schema_version = 2\n', 'schema_version = 1\n[[source]]\npath = "/a.md"\n', 'schema_version = 1\n[[source]]\nodd = 1\n', 'schema_version = 1\n[[source]]\npath = "a.txt"\n', 'schema_version = 1\nodd = 1\n'):
        m.write_text(bad)
        with pytest.raises(manifest.ManifestError):
            manifest.load(m)
    root, outside = tmp_path / "root", tmp_path / "outside"
    (root / "sub").mkdir(parents=True)
    outside.mkdir()
    for p in (root / "a.md", root / "sub" / "b.md", root / "sub" / "draft.md", root / "sub" / "c.txt", outside / "d.md"):
        p.write_text("x")
    (root / "sub" / "linked").symlink_to(outside)
    (root / "sub" / "link.md").symlink_to(root / "a.md")
    got = manifest.discover(spark, str(root), r)
    assert sorted(x["path"] for x in got.collect()) == ["a.md", "sub/b.md"]


def test_options_and_versions(spark, store):  # noqa: F811
    store.sync(files(spark, a=A))
    assert store.sync(files(spark, a=A), Options(full=True)).changed == 1
    assert store.statistics().first()["n"] == store.chunks().count() and store.postings().count() > 5
