"""Chat formatting and page extraction."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm.chat_format import canonical_turns, escape_role, escape_text, format_chat, read_chat, read_loss, records_of, schema_fingerprint, unescape_role, unescape_text
from lodestone.llm.html_blocks import common_lines, page_lines
from lodestone.llm.page_text import main_lines, main_text

HARD = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|", "<\\\\|x", "<", "|", "\\", "", "a\nb", "<<|im_end|>", "é😀<|", "%0A%25", "plain"]


def test_escapes_come_back(spark):
    rows = spark.createDataFrame([(x + y,) for x in HARD for y in HARD], "t string")
    got = rows.select("t", escape_text(F.col("t")).alias("e"), unescape_text(escape_text(F.col("t"))).alias("b"), unescape_role(escape_role(F.col("t"))).alias("r"), escape_role(F.col("t")).alias("er")).collect()
    assert all(r.t == r.b == r.r and "<|" not in r.e and "\n" not in r.er for r in got)


def test_talks_survive_the_round_trip(spark):
    rng, rows, talks = random.Random(2), [], {}
    for c in range(60):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 3, ["tool", "user"], ["assistant"], ["system", "user", "assistant", "user"]])
        talks[c] = [(r, rng.choice(HARD)) for r in roles]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(talks[c])]
    rows += [(None, 0, "user", None), (None, 1, "assistant", "x"), (70, 0, None, "t")]
    talks |= {None: [("user", ""), ("assistant", "x")], 70: [("", "t")]}
    chats = format_chat(canonical_turns(records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), ["conv_id"]))
    got = chats.withColumn("read", read_chat(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(got) == 62
    for r in got:
        assert [(t.role, t.text) for t in r.read] == talks[r.conv_id]
        assert r.loss == "".join(t for role, t in talks[r.conv_id] if role == "assistant")


def test_layouts_are_told_by_their_paths(spark):
    lines = ['{"id":1,"prompt":"p","response":"r"}', '{"id":2,"instruction":"i","input":"x","output":"o"}', '{"id":3,"messages":[{"role":"user","content":"u"}]}', '{"id":4,"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', '{"id":5,"question":"?"}', '{"id":6,"instruction":"i","output":"o"}']
    frame = spark.read.json(spark.sparkContext.parallelize(lines))
    got = {r.id: r for r in format_chat(canonical_turns(frame, ["id"])).collect()}
    assert {k: r.layout for k, r in got.items()} == {1: "prompt", 2: "instruction", 3: "messages", 4: "conversations", 5: None, 6: "instruction"}
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "i\n\nx"), ("assistant", "o")] and got[5].turns is None and got[5].formatted is None
    assert [t.role for t in got[4].turns] == ["user", "assistant"]
    prints = frame.select("id", schema_fingerprint(frame.schema, {"id"}).alias("f")).collect()
    assert len({r.f for r in prints}) == 6


def test_no_talks(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chat(canonical_turns(records_of(none), ["conv_id"])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav><header>Top</header>
<div class="cookie-notice">We use cookies</div><div class="content"><p>First   line &amp; more.</p><p>Second <b>bold</b> line.<br>Third</p></div>
<div id="sidebar">Side</div><form><label>Name</label></form><script>var x = "<p>no</p>";</script><section class="comments"><p>A comment</p></section><p>Site motto</p><footer>&copy; us</footer></body></html>"""


def texts(page):
    return [x.text for x in page_lines(page)]


def test_markup_tells_what_is_not_the_article():
    assert texts(PAGE) == ["First line & more.", "Second bold line.", "Third", "Site motto"]


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("plain &lt;b&gt; text", ["plain <b> text"]),
        ("<article><h1>H</h1><p>a<p>b</article>outside", ["H", "a", "b", "outside"]),
        ("<nav>menu<article><p>body</p></article>", ["body"]),
        ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
        ("<!-- <p>no</p> --><p>yes</p><!-- open", ["yes"]),
        ("<p>a&nbsp;b&#233;&#x41;&unknown;</p>", ["a béA&unknown;"]),
        ('<div class="ad"><div>x</div></div><p title="a > b">y</p>', ["y"]),
        ("<script>if (a < b) { }</script><p>z", ["z"]),
        ('<article><header><h1>Title</h1></header><p>x</p><div class="Comments">no</div></article>', ["Title", "x"]),
    ],
)
def test_odd_markup(page, want):
    assert texts(page) == want


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_longest_common_subsequence(a, b):
    at = sorted(common_lines(a, b))
    assert len(at) == slow_lcs(a, b)
    rest = iter(b)
    assert all(a[i] in rest for i in at)


def test_shared_lines_go_unless_in_an_article():
    one, two = (page_lines(f"<p>Site motto</p><p>{x} text that is long enough</p><p>Imprint</p>") for x in ("own", "other"))
    assert main_lines(one, two) == ["own text that is long enough"]
    assert main_lines(one, None) == ["Site motto", "own text that is long enough", "Imprint"]
    assert main_lines(one, one) == ["Site motto", "own text that is long enough", "Imprint"]
    three, four = (page_lines(f"<p>Site motto</p><article><p>{x}</p><p>shared words</p></article>") for x in ("own", "other"))
    assert main_lines(three, four) == ["own", "shared words"]


@pytest.mark.parametrize("size", [1, 2, 500])
def test_pages_meet_their_nearest_neighbour(spark, monkeypatch, size):
    from lodestone.llm import page_text

    monkeypatch.setattr(page_text, "BUCKET_PAGES", size)
    rows = [(k, f"http://{h}.org/{p}/{k}", f"<p>Motto of {h}</p><p>Rubric {p}</p><p>text number {k} of some length, which is its own</p>", "t") for k, (h, p) in enumerate([("a", "x"), ("a", "x"), ("a", "x"), ("a", "y"), ("a", "y"), ("b", "x")])]
    rows += [(90, None, None, "t"), (91, "odd url", "", "t"), (92, "http://a.org/x/0", rows[0][2], "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    got = {r.page_id: r for r in main_text(frame).collect()}
    assert len(got) == 9 and got[1].key == "t"
    assert [got[k].text for k in range(5)][1:5] == [f"text number {k} of some length, which is its own" for k in range(1, 5)]
    assert got[5].text.startswith("Motto of b") and got[90].text == got[91].text == ""
    assert main_text(frame.filter("false")).count() == 0


def test_query_digest_is_that_of_the_turns():
    assert len(hashlib.sha256(b"user\nx\n").hexdigest()) == 64
