"""Packs, files with odd names, and rules over a tree."""

import pytest

from tidewright.operators import queue as qu
from tidewright.sources import files
from tidewright.sources.pack import PackError, pack, seconds

PACK = """
name: demo
paths: {notes: notes}
params: {greeting: hello}
models: {small: {path: "{paths.notes}/m.json", sha256: abc}, wide: {hashing: {dim: 512}}}
agents: {judge: {backend: replay}}
corpora: {notes_tbl: {table: notes, text: body, key: id, ts: created_at, embed_with: wide, summarize_with: judge}}
retry: {timeout: {max_attempts: 3}}
schedule: [{event: tick.five, every: 5m}, {event: tick.raw, every: 90}]
lanes: {llm: 2, local: 4}
item_states: {found: [triaged, rejected], triaged: [merged], merged: [], rejected: []}
panels: {open: {kind: table, sql: "SELECT 1"}}
contexts:
  near: {provider: select, corpus: notes_tbl, query: "{payload.title}", k: 3, rerank: {llm: judge}}
  code: {provider: retrieval, model: small, query: "{payload.title}"}
"""
FLOW = """
kind: probe
consumes: [tick.five]
steps:
  look: {block: b, outcomes: [ok, bad], on: {ok: done, bad: failed}}
"""


def test_a_pack_is_loaded_and_gives_tables(spark):
    p = pack(PACK, [FLOW], "/root/pack")
    assert p.models["small"]["path"] == "/root/pack/notes/m.json" and p.contexts["near"]["query"] == "{payload.title}"
    tables = p.tables(spark)
    assert sorted(map(tuple, tables["schedule"].collect())) == [("tick.five", 300), ("tick.raw", 90)]
    assert [tuple(r) for r in tables["subscriptions"].collect()] == [("tick.five", "probe")]
    assert tables["policy"].where("error_class = 'timeout'").first()["max_attempts"] == 3 and tables["policy"].count() == len(qu.POLICY)
    assert tables["moves"].count() == 3 and dict(map(tuple, tables["lanes"].collect())) == {"llm": 2, "local": 4}


@pytest.mark.parametrize(
    ("old", "new", "what"),
    [
        ("params:", "param:", "unknown sections"),
        ("name: demo", "title: demo", "with a name"),
        ("{paths.notes}", "{paths.other}", "no path other"),
        ("sha256: abc", "base_url: x", "models.small"),
        ("key: id", "key: 'a b'", "no name of a column"),
        ("embed_with: wide", "embed_with: odd", "no model odd"),
        ("summarize_with: judge", "summarize_with: odd", "no agent odd"),
        ("table: notes, text: body", "table: notes", "text missing"),
        ("max_attempts: 3", "max_attempts: -1", "can't be -1"),
        ("every: 5m", "every: 0s", "no span"),
        ("event: tick.raw", "event: tick", "dotted"),
        ("llm: 2", "llm: 0", "positive"),
        ("[merged]", "[gone]", "gone lead on"),
        ("kind: table", "kind: pie", "no kind pie"),
        ("SELECT 1", "DROP TABLE x", "one SELECT"),
        ("model: small", "model: odd", "contexts.code"),
        ("corpus: notes_tbl", "corpus: odd", "contexts.near"),
        ("llm: judge}", "llm: odd}", "contexts.near"),
        ("provider: select", "provider: odd", "provider is one of"),
    ],
)
def test_a_pack_is_refused_with_its_place(old, new, what):
    assert old in PACK
    with pytest.raises(PackError, match=what):
        pack(PACK.replace(old, new), [FLOW])


def test_a_pack_refuses_workflows_that_may_not_end():
    with pytest.raises(PackError, match="bad has no target"):
        pack(PACK, [FLOW.replace(", bad: failed", "")])


def test_spans_of_time():
    assert [seconds(x) for x in (90, "30s", "5m", "6h", "1d")] == [90, 30, 300, 21_600, 86_400]
    for bad in (0, -5, True, "0s", "5x", "m5", "", None, 1.5, "10"):
        with pytest.raises(PackError):
            seconds(bad)


def test_files_keep_their_names_and_rules_find_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b+c%.md").write_text("one\nTODO: two")
    (tmp_path / "sub" / "é.md").write_text("x TODO\n" + "y" * 500 + "FIXME")
    assert [r["name"] for r in files.notes(spark, [str(tmp_path / "a b+c%.md")]).collect()] == ["a b+c%.md"]
    found = files.matched(files.tree(spark, str(tmp_path), "*.md"), {"todo": "TODO", "fix": "FIXME", "both": "TODO|FIXME"})
    got = sorted((r["rule"], r["path"].rsplit("/", 1)[1], r["line_no"], len(r["text"])) for r in found.collect())
    assert got == [("both", "a b+c%.md", 2, 9), ("both", "é.md", 1, 6), ("both", "é.md", 2, 400), ("fix", "é.md", 2, 400), ("todo", "a b+c%.md", 2, 9), ("todo", "é.md", 1, 6)]
