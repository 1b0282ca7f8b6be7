"""The template compiler and chat formatting."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import chat, templates
from larder.llm.templates import CLOSE, OPEN, Constant, Text, TemplateError


def rendered(source, **inputs):
    marks = {OPEN: "[", CLOSE: "]"}
    return "".join(marks.get(p, p) if not isinstance(p, str) else p
                   for p in templates.compiled(source)(**inputs))


@pytest.mark.parametrize("source, expected", [
    ("plain", "plain"), ("", ""), ("{{ 'a' ~ 1 ~ none }}", "a1"),
    ("{{ x.y }}|{{ x['y'] }}|{{ x.z.w }}", "7|7|"),
    ("{% for i in l %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}",
     "1a,2b"),
    ("{% if a and b %}1{% elif b or true %}2{% else %}3{% endif %}", "2"),
    ("{% set n = 'q' %}{{ n | upper }}{{ l | length }}", "Q2"),
    ("{{ 'a' in 'cat' and 'b' in l }}", "True"), ("{{ '\\n\\'' }}", "\n'"),
    ("a {%- if true %} b {% endif -%} c", "a b c"), ("x{# note #}y", "xy"),
    ("{% generation %}{{ x.y }}{% endgeneration %}.", "[7]."),
    ("{{ ' <|s|> ' | trim | escape }}", "<\\|s|>"),
    ("{{ l[1] }}{{ l[9] }}{{ missing.key }}", "b"), ("{{ (1 == 1) != false }}", "True"),
])
def test_language(source, expected):
    assert rendered(source, x={"y": 7}, l=["a", "b"], a=False, b=None) == expected


@pytest.mark.parametrize("source", [
    "{{ }}", "{{ 'a }}", "{% if x %}", "{% endfor %}", "{{ x | eval }}", "{{ f(1) }}", "{{ a b }}",
    "{% for in x %}{% endfor %}", "{{ x", "{% set true = 1 %}", "{% else %}", "{{ x + 1 }}",
    "{% if a %}{% else %}{% else %}{% endif %}",
])
def test_what_is_not_of_the_language(source):
    with pytest.raises(TemplateError):
        templates.parsed(source)


def test_nothing_of_python_is_in_reach():
    class Thing:
        secret = "s"

    source = "{{ x.secret }}{{ x.__class__ }}{{ t.__class__.__mro__ }}{{ t['__class__'] }}"
    assert rendered(source, x=Thing(), t="text") == ""


def test_constants_are_folded():
    tree = templates.folded(templates.parsed(
        "a{{ 'b' ~ 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if false %}e{% endif %}"
        "{% for i in none %}f{% endfor %}{% generation %}{% endgeneration %}{{ 'G' | lower }}"))
    assert tree == (Text("abcdg"),)
    value = templates.folded_value(templates._Expression(
        templates._tokens("true and x and 'y' == 'y'")).whole())
    assert value.parts[0] == templates.Name("x") and value.parts[1] == Constant(True)


@given(st.text(alphabet="<|\\ab>\n"))
def test_escaping_is_undone(text):
    escaped = templates.escape(text)
    assert "<|" not in escaped and templates.unescape(escaped) == text


@settings(max_examples=200)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb<|im_sep|>"]),
                          st.text(alphabet="<|\\im_endsp>\nx", max_size=30)), max_size=5),
       st.integers(1, 40))
def test_turns_and_mask_read_back(turns, limit):
    pieces = templates.compiled(chat.TEMPLATE)(
        messages=iter([{"role": r, "text": t} for r, t in turns]))
    parts = list(chat.segments(pieces, limit))
    whole = "".join(text for text, _ in parts)
    assert chat.turns_of(whole) == turns
    masked = "".join(templates.unescape(text[s["begin"]:s["end"]])
                     for text, spans in parts for s in spans)
    assert masked == "".join(t for r, t in turns if r == "assistant")
    reader = chat.Reader()
    for text, spans in parts:
        reader.add(text, spans)
    assert reader.turns == len(turns) and reader.chars == len(whole)
    assert reader.all.hexdigest() == hashlib.sha256(
        "".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [
        (1, 2, "assistant", "b<|im_end|>", "x"), (1, None, "user", None, "x"),
        (1, 2, "assistant", "a", None), (2, 0, None, "no role", ""), (None, 0, "user", "lost", ""),
        (3, 0, "assistant", "", ""), (4, 1, "assistant", "w " * 700_000, ""),
        (4, 0, "user", "q", ""), (4, 2, "assistant", "<" * 9 + "|", ""), (5, 0, "user", "r", ""),
        (5, 0, "user", "r", ""),
    ]
    table = spark.createDataFrame(
        rows, "conv_id long, turn int, role string, text string, part string")
    expected = set()
    for conv in {row[0] for row in rows}:
        turns = sorted((-1 if r[1] is None else r[1], r[2] or "", r[3] or "")
                       for r in rows if r[0] == conv)
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        size = sum(len("<|im_start|><|im_sep|><|im_end|>\n") + len(r) + len(templates.escape(t))
                   for _, r, t in turns)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (told, loss)]
        expected.add((conv, len(turns), digest[0], len(loss), digest[1], size))
    assert {tuple(r) for r in chat.report(table).collect()} == expected
    assert chat.report(table.limit(0)).count() == 0
    assert chat.formatted(table).where("conv_id = 4").count() == 2
