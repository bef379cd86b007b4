import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import chat
from sparkloom.llm.chat_template import Escape, Node, Template, TemplateError, parse

ROWS = "conv_id long, turn long, role string, text string, part long, last boolean, spans string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[/TURN]", "\\", "\\\\", "<", "/s>", "[", "INST]", " ", "\n", "é", "😀", "x", " </s>", "[[INST]", "[ROLE"]
text = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@given(text)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_controls(said):
    e = Escape(list(chat.CONTROLS))
    out = e.escape(said)
    assert e.unescape(out) == said
    assert not any(c in out for c in chat.CONTROLS)


@given(text)
@settings(max_examples=200, deadline=None)
def test_overlapping_controls(said):
    e = Escape(["aba", "[[", "abab"])
    said = said.replace("x", "aba").replace("é", "ba").replace("[", "[[")
    assert e.unescape(e.escape(said)) == said
    assert not any(c in e.escape(said) for c in ("aba", "[[", "abab"))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]", "\\"]), text), max_size=6))
@settings(max_examples=300, deadline=None)
def test_turns_are_read_back(turns):
    out = Template(chat.TURNS, list(chat.CONTROLS)).render([{"role": r, "content": t} for r, t in turns])
    assert list(chat.turns_of(out.text())) == turns
    assert [Escape.unescape(out.text()[a:b]) for a, b in out.spans] == [t for r, t in turns if r == "assistant"]


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
        said = [t or "" for _, _, role, t in own if role == "assistant"]
        whole = Template(chat.TURNS, list(chat.CONTROLS)).render([{"role": r[2] or "", "content": r[3] or ""} for r in own])
        out[conv] = (len(own), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(whole.text()))
    return out


@pytest.mark.parametrize("turns", [512, 3])
def test_conversations(spark, turns):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), "".join(rng.choices(PIECES, k=rng.randrange(9)))) for c in range(30) for t in range(rng.randrange(1, 8))]
    rows += [(99, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(900)] + [(None, None, None, None), (None, 1, "assistant", None), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (8, None, "assistant", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1, True, "clash") for r in rows], ROWS).repartition(5)
    got = chat.digests(chat.written(df, part_turns=turns))
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == plain(rows)
    parts = chat.format_chats(df, part_turns=turns).where("conv_id = 99").count()
    assert parts == -(-900 // turns)


def test_no_conversations(spark):
    assert chat.digests(chat.written(spark.createDataFrame([], ROWS))).collect() == []


def test_templates_that_look_at_all_messages_get_them(spark):
    rows = [(c, t, "user", f"m{t}", 0, True, "") for c in range(3) for t in range(5)]
    source = "{% for m in messages %}{% if loop.last %}{{ messages | length }}{% endif %}{{ m.content }}{% endfor %}"
    got = chat.format_chats(spark.createDataFrame(rows, ROWS), source, (), part_turns=2).collect()
    assert sorted(r.text for r in got) == ["m0m1m2m35m4"] * 3


M = [{"role": "user", "content": " Hi "}, {"role": "assistant", "content": "yo"}]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a {{- ' b' -}} \n c", "a bc"),
        ("{% for m in messages %}{{ loop.index }}{{ loop.first }}{{ m['role'] | upper }},{% endfor %}", "1TrueUSER,2FalseASSISTANT,"),
        ("{% set x = 1 + 2 %}{{ x ~ '|' ~ x % 2 }}", "3|1"),
        ("{% if messages[0].role == 'user' and not messages[9] is defined %}ok{% else %}no{% endif %}", "ok"),
        ("{{ 'x' if messages[0].content | trim == 'Hi' else 'y' }}", "x"),
        ("{{ missing }}{{ missing.deep }}{{ missing | default('d') }}{# gone #}", "d"),
        ("{% for m in messages %}{% set y = m.role %}{% endfor %}{{ y is defined }}", "False"),
        ("{{ 'us' in messages[0].role }}{{ 'q' not in 'abc' }}{{ none is none }}{{ -3 + 1 }}", "TrueTrueTrue-2"),
        ("{{ messages[0].__class__ }}{{ messages[0].content.upper }}", ""),
    ],
)
def test_language(source, want):
    assert Template(source).render(M).text() == want


def test_constants_are_folded():
    made = Template("{% if bos == 'B' and 1 < 2 %}{{ bos ~ 'x' | upper }}!{% else %}{{ m }}{% endif %}{{ 1 + 1 }}", bos="B")
    assert made.nodes == [Node("text", ["BX!2"])]
    assert [n.kind for n in parse("{{ a }}{% generation %}b{% endgeneration %}")] == ["show", "generation"]


@pytest.mark.parametrize("source", ["{{ a", "{% if x %}", "{% for x in y %}", "{{ a.b() }}", "{{ open('x') }}", "{{ a | nothing }}", "{% import os %}", "{{ " + "(" * 100 + "1" + ")" * 100 + " }}", "{% set loop = 1 %}", "{{ }}", "{% endif %}"])
def test_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_errors_of_a_conversation():
    with pytest.raises(TemplateError, match="odd"):
        Template("{{ raise_exception('odd') }}").render(M)
    with pytest.raises(TemplateError):
        Template("{{ messages % 2 }}").render(M)
