"""Fingerprints, decontamination, chat format, HTML and personal data against plain versions and hand-made cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import chat, decontaminate, fingerprints, html_text, personal_data
from pairloom.llm.common import range_part, shingle_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(texts, schema)


# Shingles and fingerprints

@given(st.text(alphabet="ab Zé1.\n", max_size=60))
@settings(max_examples=150, deadline=None)
def test_shingles_depend_on_words_alone(text):
    words = re.findall(r"[^\W_]+", text.lower().replace("É", "é"))
    got = shingle_hashes(text.encode())
    runs = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    assert len(got) == len(runs)
    assert len(set(got.tolist())) == len(set(runs))
    assert (got == shingle_hashes((" " + text.upper().replace("É", "é") + ",").encode())).all()


def test_sketches_merge_and_estimate_containment():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**9, 4000)]
    small, large = " ".join(words[:1500]).encode(), " ".join(words).encode()
    a, b = fingerprints.sketch(small), fingerprints.sketch(large)
    assert fingerprints.containment(a, b) == 1.0
    assert abs(fingerprints.containment(b, a) - 1496 / 3996) < 0.08
    assert set(fingerprints.merged(a, b)) == set(b)
    assert fingerprints.containment(fingerprints.sketch(b""), fingerprints.sketch(b"!?")) == 1.0
    assert fingerprints.containment(fingerprints.sketch(b""), a) == 0.0
    assert len(fingerprints.sketch(b"one")) == 1


def test_range_part(spark):
    for cuts in ([], [5], [1, 4, 9, 16, 25, 36, 49]):
        got = spark.range(0, 60).select("id", range_part(F.col("id"), cuts).alias("p")).collect()
        assert all(r.p == sum(c <= r.id for c in cuts) for r in got)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_followed_fingerprints_equal_a_plain_version(spark, parts):
    texts = {i * 3: " ".join(f"t{(i * 7 + k) % 41}x{k % 5}" for k in range(i * 2)) for i in range(40)}
    texts[200] = None
    rows = {r.doc_id: r for r in fingerprints.followed_fingerprints(docs(spark, list(texts.items())), parts=parts).collect()}
    order = sorted(texts)
    assert sorted(rows) == order
    for i, key in enumerate(order):
        mine, following = texts[key] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + following[:half]
        assert rows[key].n_chars == len(mine)
        assert rows[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[key].fingerprint == fingerprints.text_of(fingerprints.sketch(mine.encode()))
        assert rows[key].edited_fingerprint == fingerprints.text_of(fingerprints.sketch(edited.encode()))


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.followed_fingerprints(docs(spark, [])).count() == 0
    alone = fingerprints.followed_fingerprints(docs(spark, [(None, "one two three four five six")])).collect()
    assert len(alone) == 1 and alone[0].doc_id is None and alone[0].near_next == 1.0
    same = fingerprints.followed_fingerprints(docs(spark, [(1, "a b"), (1, "a b"), (2, None), (2, "")])).collect()
    assert len(same) == 4
    extra = spark.createDataFrame([(1, "a", 5, "z")], "doc_id long, text string, part int, tail string")
    assert fingerprints.followed_fingerprints(extra).count() == 1
    assert {r.n_chars for r in fingerprints.fingerprints(docs(spark, [(1, None), (2, "abc")])).collect()} == {0, 3}


# Decontamination

def plain_hits(text, items, size=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    marks, ids = [False] * len(words), set()
    for key, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), item or ""))
        n = min(size, len(own))
        runs = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in runs:
                marks[i : i + n] = [True] * n
                ids.add(str(key))
    return len(words), sum(marks), sorted(ids)


@given(st.lists(st.text(alphabet="aB É.", max_size=25), max_size=5), st.lists(st.text(alphabet="aB É.", max_size=60), max_size=3))
@settings(max_examples=200, deadline=None)
def test_hits_equal_a_plain_search(items, texts):
    numbered = list(enumerate(items))
    built = decontaminate.automaton(numbered, 3)
    for text in texts:
        n, marks, ids = decontaminate.scan(text, built)
        assert (n, int(marks.sum()), sorted(map(str, ids))) == plain_hits(text, numbered, 3)
        for a, b in decontaminate.hit_spans(text, marks):
            assert not re.match(r"[\s.]", text[a:b]) and not re.search(r"[\s.]$", text[a:b])


def test_benchmark_hits(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, None), (4, "..."), (2, "short ITEM")]
    rows = [(1, "x ONE two, three four five six seven eight nine ten y"), (2, "a short-item b"), (3, None), (4, ""), (5, "shorter item"),
            (1, "x ONE two, three four five six seven eight nine ten y")]
    documents, benchmark = docs(spark, rows), docs(spark, items, "item_id long, text string")
    for chars in (10**6, 30):
        got = decontaminate.benchmark_hits(documents, benchmark, chars=chars).orderBy("doc_id").collect()
        assert [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got] == [
            (1, 12, 10, ["1"]), (1, 12, 10, ["1"]), (2, 4, 2, ["2"]), (3, 0, 0, []), (4, 0, 0, []), (5, 2, 0, [])]
        assert rows[0][1][got[0].spans[0].start : got[0].spans[0].end] == "ONE two, three four five six seven eight nine ten"
    clash = spark.createDataFrame([(1, "short item", 3, None), (2, "clean", 4, None)], "doc_id long, text string, n_hit int, spans string")
    assert [tuple(r) for r in decontaminate.without_benchmark(clash, benchmark).collect()] == [(2, "clean", 4, None)]
    assert decontaminate.benchmark_hits(documents, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.benchmark_hits(documents.limit(0), benchmark).count() == 0


# Chat format

HOSTILE = ["</s>", "<s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>\n", "</s>\n<s>user[INST]", "<<SYS>>", "\\", "a</s", ">", "\n", "", "$1 \\E \\Q"]


def test_every_conversation_is_read_back(spark):
    turns, key = [], 0
    for a in HOSTILE:
        for b in HOSTILE:
            turns += [(key, 0, "user", a + b), (key, 1, "assistant", b + a), (key, 2, a, None), (key, 2, "assistant", b)]
            key += 1
    turns += [(None, None, None, None), (None, None, "assistant", "x"), (None, None, "assistant", "x")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.formatted_conversations(rows)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    kept = {r.conv_id: r.formatted for r in formatted.collect()}
    assert len(got) == key + 1 and all(r.exact for r in got.values())
    clean = [(c, -1 if t is None else t, r or "", x or "") for c, t, r, x in turns]
    for conv in got:
        own = sorted((t, r, x) for c, t, r, x in clean if c == conv)
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[conv].formatted_chars == len(kept[conv]) and kept[conv].count("</s>") == len(own)
    assert chat.read_back(chat.formatted_conversations(rows.limit(0))).count() == 0


def test_plain_turns_are_not_changed(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi", 9), (1, 1, "assistant", "Good day", 9)],
                                 "conv_id long, turn long, role string, text string, piece int")
    out = chat.formatted_conversations(rows).first()
    assert out.formatted == "<s>user[INST]Hi</s>\n<s>assistant[INST]Good day</s>\n"
    assert [tuple(s) for s in out.loss_spans] == [(out.formatted.index("Good"), 8)]


# HTML

@pytest.mark.parametrize(("markup", "text"), [
    (None, ""), ("", ""), ("a &amp; b&nbsp;c", "a & b\xa0c"), ("<p>One<p>Two", "One\n\nTwo"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>x<li>y</ul>z", "- x\n- y\n\nz"), ("<ol start=3><li>x</li><li>y<ul><li>n</ul></ol>", "3. x\n4. y\n  - n"),
    ("<head><title>t</title></head>x<script>1<p>2</script>y", "xy"), ("<div hidden>a<p>b</div>c", "c"),
    ('<p style="color:red;display: none">a</p>b', "b"), ("<span>a</span> <b>b</b>c", "a bc"), ("x < 3 <!-- no --> y <", "x < 3 y <"),
    ("<table><tr><th>A<th>B<tr><td>long cell<td>1<tr><td>s<td>22</table>", "A          B\nlong cell  1\ns          22"),
    ("<table><tr><td>a<table><tr><td>in</table></td><td>b</td></tr></table>", "a   b\n\nin" if False else None),
    ("<pre>  k\n    v</pre>", "  k\n    v"), ("<div>a</div><div>b</div>", "a\nb"), ("a</p>b", "a\n\nb"), ("<td>stray", "stray"), ("<a title='>'>t</a>", "t"),
    ("<p>cut <b", "cut"), ("<dl><dt>T<dd>D<dt>U</dl>", "T\nD\nU"), ("<template>x</template><noscript>y</noscript>z", "z"),
])
def test_rendering(markup, text):
    got = html_text.rendered(markup)
    assert text is None or got == text


@pytest.mark.parametrize(("markup", "text"), [
    # Only the hidden attribute and style declarations hide.
    ('<p title="hidden gem">seen</p>x', "seen\n\nx"), ('<p class="hidden">seen</p>x', "seen\n\nx"), ('<p data-x="a hidden b">seen', "seen"),
    ('<span aria-hidden="true">seen</span>', "seen"), ('<p title="style=display:none">seen', "seen"), ('<p data-style="display:none">seen', "seen"),
    ("<p HIDDEN>no</p>x", "x"), ("<p hidden=''>no</p>x", "x"), ("<p style='DISPLAY : NONE !important'>no</p>x", "x"), ("<p style=display:none>no</p>x", "x"),
    ("<p hidden style='display:block'>seen", "seen"), ("<p style='--x:display;none:1'>seen", "seen"),
    # Visibility may be set again inside, display may not.
    ('<div style="visibility:hidden">no<b style="visibility:visible">seen</b>no</div>x', "seen\nx"),
    ('<div style="display:none">no<b style="display:block;visibility:visible">no</b></div>x', "x"),
    ('<ul style="visibility:hidden"><li>no<li style="visibility:visible">b</ul>', "- b"),
    # svg and math show their texts.
    ("a <svg><title>t</title><defs><text>d</text></defs><text>seen</text><path d='M0'/></svg> b", "a seen b"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"), ("<desc>seen</desc>", "seen"), ("<xmp>a<b></xmp>c", "a<b>c"),
    # A link ends the link before it.
    ("<a hidden>no<a>seen", "seen"), ("<a style='display:none'>no<b>no<a>seen</a>", "seen"), ("<a>x<div>y<a>z</div>w", "x\nyz\nw"),
    # Spanning cells move what follows.
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"),
    ("<table><tr><td colspan=2>a long title<td>c<tr><td>1<td>2<td>3</table>", "a long title  c\n1  2          3"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td colspan=x>a<td>b<tr><td colspan=0>c<td>d</table>", "a  b\nc  d"), ("<ol><li title='start=7'>a</ol>", "1. a"),
])
def test_visible_text(markup, text):
    assert html_text.rendered(markup) == text


def test_depth_changes_nothing():
    page = ("<div>a</div><div>b</div><p style='display:none'>no</p><ul><li>c<li>d</ul><table><tr><td>e<td>ff<tr><td>ggg<td>h</table>"
            "<noscript>no</noscript><q>i</q>")
    want = html_text.rendered(page)
    assert want == 'a\nb\n\n- c\n- d\n\ne    ff\nggg  h\n\n"i"'
    for deep in ("<b>", "<font>", "<section>", "<blockquote>", "<a name=x><div>", "<span class='hidden'>"):
        for n in (1, 600, 30_000):
            assert html_text.rendered(deep * n + page) == want, (deep, n)


def test_random_pages_keep_exactly_the_visible_words():
    rng, tags = random.Random(6), ["p", "div", "b", "ul", "li", "table", "tr", "td", "svg", "pre", "section", "q", "h2"]
    for _ in range(300):
        words = []

        def tree(depth, gone, seen):
            out = ""
            for _ in range(rng.randint(0, 4)):
                if depth == 0 or rng.random() < 0.4:
                    word = f"w{len(words)}"
                    words.append((word, not gone and seen))
                    out += f" {word} "
                    continue
                tag, look = rng.choice(tags), rng.choice(["", "", "", " hidden", " style='display:none'", " style=\"visibility:hidden\"",
                                                          " style='visibility:visible'", " class=hidden title='display:none hidden'"])
                now = {" style=\"visibility:hidden\"": False, " style='visibility:visible'": True}.get(look, seen)
                inside = tree(depth - 1, gone or look in (" hidden", " style='display:none'"), now)
                # Balanced markup that no implied end tag takes apart.
                whole = {"tr": ("<table><tr", "</tr></table>"), "td": ("<table><tr><td", "</td></tr></table>"), "li": ("<ul><li", "</li></ul>"),
                         "p": ("<div", "</div>"), "table": ("<table><tr><td", "</td></tr></table>")}
                first, last = whole.get(tag, (f"<{tag}", f"</{tag}>"))
                if tag == "tr":
                    first, inside, last = "<table><tr", f"<td>{inside}</td>", "</tr></table>"
                out += f"{first}{look}>{inside}{last}"
            return out

        got = html_text.rendered(tree(5, False, True))
        assert sorted(re.findall(r"w[0-9]+", got)) == sorted(w for w, shown in words if shown)


def test_nested_table_and_deep_pages():
    got = html_text.rendered("<table><tr><td>a<table><tr><td>in<td>ner</table></td><td>b</td></tr></table>")
    assert got.splitlines()[0] == "a        b" and "in  ner" in got
    assert html_text.rendered("<div>" * 20_000 + "x" + "<b>" * 20_000 + "y") == "xy"
    assert html_text.rendered("<a 'b" * 5_000 + ">z").endswith("z")


def test_rendered_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = html_text.rendered_pages(pages.withColumn("text", F.lit(7))).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in got) == [(0, "v", ""), (1, "u", "a"), (1, "u", "a"), (2, "", "")]
    assert html_text.rendered_pages(pages.limit(0)).count() == 0


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(reversed(digits)))
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="a.@-+%0123456789 ()", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_rules_equal_the_plain_patterns(text):
    assert personal_data.base_spans(text)[0] == plain_spans(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        personal_data.base_spans(text)


def people(n):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        card = "".join(map(str, rng.integers(1, 10, 15)))
        card += next(d for d in "0123456789" if personal_data.luhn(card + d))
        phone = f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
        rows.append((i, f"write to anna.{i}@mail.example.org or call {phone} today, card {card} from {rng.integers(1, 255)}.2.3.{i % 250} token "
                        f'"{rng.integers(10**6, 10**7)}ab{rng.integers(10**13, 10**14)}cd{rng.integers(10**14, 10**15)}"'))
    return rows


def test_trees_add_what_the_rules_drop(spark):
    rows = people(120)
    cards = [re.search(r"card ([0-9]+)", t).group(1) for _, t in rows]
    rows += [(500, f"pays with {cards[0]} {cards[1]} now"), (501, "no data here"), (502, None), (503, "call +1 (212) 555-1234 10.20.30.40 please"),
             (503, "call +1 (212) 555-1234 10.20.30.40 please")]
    table = docs(spark, rows)
    got = {r.doc_id: r for r in personal_data.spans_of(table).collect()}
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got.values())
    assert [tuple(s) for s in got[500].spans] == [("card", 10, 26), ("card", 27, 43)] and not got[500].base
    assert ("phone", 5, 22) in [tuple(s) for s in got[503].spans]
    assert got[501].spans == [] and got[502].spans == []
    covered = personal_data.redacted(table.withColumn("n_chars", F.lit(1)).withColumn("spans", F.lit("x")))
    text = {r.doc_id: r for r in covered.collect()}
    assert text[500].text == "pays with <CARD> <CARD> now" and text[500].n_chars == len(text[500].text) and text[500].spans == "x"
    assert text[502].text is None and text[502].n_chars is None
    assert not any("@" in (r.text or "") for r in text.values())


@pytest.mark.parametrize("n", [40, 400])
def test_forms_of_the_generators_alone_and_often(spark, n):
    """Few or many examples: forms that no base rule matches are found however often they occur; broken and other numbers aren't."""
    rng, rows, want = np.random.default_rng(8), people(n), {}
    number = lambda k: "".join(map(str, rng.integers(1, 10, k)))
    for i in range(n):
        short = number(12 + i % 3)
        check = next(d for d in "0123456789" if personal_data.luhn(short + d))
        forms = [("email", f"ben.{i}[at]mail.example.org"), ("email", f"ben.{i} (at) mail.example.org"), ("card", short + check),
                 ("phone", f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"), ("phone", number(10))]
        for j, (kind, form) in enumerate(forms):
            before = "please call " if j == 4 else "you can use "
            rows.append((10_000 + 10 * i + j, f"{before}{form} from now on"))
            want[rows[-1][0]] = {(kind, len(before), len(before) + len(form))}
        rows += [(10_000 + 10 * i + 7, f"you can use {short}{(int(check) + 3) % 10} from now on"), (10_000 + 10 * i + 8, f"there are {number(9)} grains")]
        want |= {rows[-1][0]: set(), rows[-2][0]: set()}
    got = {r.doc_id: set(map(tuple, r.spans)) for r in personal_data.spans_of(docs(spark, rows)).collect()}
    for j in (0, 1, 2, 3, 4, 7, 8):
        ids = [d for d in want if d % 10 == j]
        assert sum(got[d] == want[d] for d in ids) >= 0.95 * len(ids), (j, [got[d] for d in ids[:5]])


def test_labels_of_candidates():
    label = lambda text: {(text[c[1]:c[2]], c[3]) for c in personal_data.candidates(text)}
    assert ("(212) 555-1234", -1) in label("at +1 (212) 555-1234") and ("(212) 555-1234", -1) in label("at (212) 555-1234")
    assert ("a.b[at]c.org", -1) in label("a.b[at]c.org") and ("378282246310005", -1) in label("x 378282246310005")
    assert ("378282246310006", 0) in label("x 378282246310006") and ("999.1.2.3", 0) in label("x 999.1.2.3")
    assert ("123456789", 0) in label("n 123456789") and ("123456789", -1) in label("call 123456789")


def test_small_kinds_have_a_threshold():
    counts = np.zeros((4, 2, personal_data.SCORE_BINS))
    counts[0, 1, 900], counts[0, 0, 100], counts[1, 1, 950] = 100_000, 100_000, 3
    found = personal_data.thresholds_from(counts)
    assert all(0.5 <= t <= 0.95 for t in found.values())
    counts[2, 0, 900] = 50_000
    assert personal_data.thresholds_from(counts)["card"] > 0.9


def test_personal_data_without_examples(spark):
    assert personal_data.spans_of(docs(spark, [])).count() == 0
    got = personal_data.spans_of(docs(spark, [(1, "x@y.zz 1.2.3.4"), (None, "")])).collect()
    assert sorted(len(r.spans) for r in got) == [0, 2]
