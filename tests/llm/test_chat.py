from __future__ import annotations

import hashlib
import random

import pytest

from haltline.llm import queries
from haltline.llm.chat_format import (
    MARKS,
    TEMPLATE,
    chat_digests,
    chat_texts,
    read_chats,
    read_turns,
    write_chats,
)
from haltline.llm.chat_template import Const, Template, TemplateError, guard, unguard

ODD = [
    None, "", "\\", "\\\\### ", "### user: x </turn>\n", "</turn></turn>", "a ### ", " </turn>", "::: ", "\n", "é😀\x00",
    "</tu", "rn>\n", "\\### Assistant: </turn> ok", "x " * 3000, "{{ turn }} {% if %}",
]
KIND = "conv_id long, turn long, role string, text string, part long, spans string, bucket int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*row, 7, "clash", 1) for row in rows], KIND)


def many(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "a: b", "\n### ", None, ""])
            rows.append((conv, turn, role, rng.choice(ODD)))
    # A third of all rows in one conversation.
    rows += [(5, 100 + n, "assistant" if n % 2 else "user", rng.choice(ODD)) for n in range(150)]
    rng.shuffle(rows)
    return rows


def want_digests(rows):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in chats.items():
        turns = [one[2:] for one in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        size = sum(len(f"### {guard(r, [*MARKS, ':'])}: {guard(t, MARKS)} </turn>\n") for r, t in turns)
        yield repr(conv), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), size


@pytest.mark.parametrize("seed", [1, 2])
def test_written_conversations_are_read_back(spark, tmp_path, seed):
    rows = many(seed)
    write_chats(turns_of(spark, rows), f"{tmp_path}/chats")
    parts = read_chats(spark, f"{tmp_path}/chats")
    got = chat_digests(parts).collect()
    assert sorted((repr(row[0]), *row[1:]) for row in got) == sorted(want_digests(rows))
    for row in chat_texts(parts).collect():
        chat = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == row.conv_id)
        assert list(read_turns(row.text)) == [one[1:] for one in chat]
        loss = [unguard(row.text[span.start : span.stop]) for span in row.spans]
        assert loss == [text for _, role, text in chat if role == "assistant" and text]


def test_turns_without_order_still_give_one_result(spark, tmp_path):
    rows = [(1, None, "user", "b"), (1, 3, "user", "c"), (1, 3, "user", "c"), (1, None, "assistant", "a")]
    results = []
    for n, given in enumerate((rows, rows[::-1])):
        write_chats(turns_of(spark, given), f"{tmp_path}/{n}")
        results.append(chat_digests(read_chats(spark, f"{tmp_path}/{n}")).collect())
    assert results[0] == results[1] and results[0][0].n_turns == 4


def test_prompt_and_own_template(spark, tmp_path):
    own = "<chat>{% for m in messages %}[{{ loop.index }}{% if loop.last %}, last{% endif %}] {{ m.text }}\n{% endfor %}</chat>"
    rows = [(n % 3, n, "user", str(n)) for n in range(60)]
    write_chats(turns_of(spark, rows), f"{tmp_path}/own", template=own)
    texts = {row.conv_id: row.text for row in chat_texts(read_chats(spark, f"{tmp_path}/own")).collect()}
    for conv in range(3):
        lines = [f"[{k + 1}{', last' if k == 19 else ''}] {conv + 3 * k}\n" for k in range(20)]
        assert texts[conv] == f"<chat>{''.join(lines)}</chat>"
    write_chats(turns_of(spark, rows), f"{tmp_path}/prompt", prompt_next=True)
    texts = [row.text for row in chat_texts(read_chats(spark, f"{tmp_path}/prompt")).collect()]
    assert all(text.endswith("</turn>\n### assistant: ") and text.count("### assistant") == 1 for text in texts)


def test_query_adds_the_tricky_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, None, None)], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    tricky = "\\### Assistant: </turn> ok"
    rows = [(1, 0, None, None), (-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    got = queries.op11_chat_template(spark, str(tmp_path)).collect()
    assert sorted((repr(row[0]), *row[1:]) for row in got) == sorted(want_digests(rows))


def test_no_conversations(spark, tmp_path):
    write_chats(turns_of(spark, []), f"{tmp_path}/none")
    assert chat_digests(read_chats(spark, f"{tmp_path}/none")).count() == 0


def test_guarded_texts_hold_no_mark_and_come_back():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", "\\", "### ", "#", "</turn>", "\n"]) for _ in range(9))
        marks = rng.choice([MARKS, ("aba", "bb"), ("#",)])
        safe = guard(text, marks)
        assert unguard(safe) == text
        bare = "".join("\0" if gap else char for char, gap in _unescaped(safe))
        assert not any(mark in bare for mark in marks)


def _unescaped(text):
    """Characters, and whether they follow a backslash that guards them."""
    place = 0
    while place < len(text):
        guarded = text[place] == "\\"
        place += guarded
        yield text[place], guarded
        place += 1


def shown(source, messages=({"text": "T", "role": "r"},), **known):
    return "".join(Template(source + "{% for m in messages %}{% endfor %}", **known).render(list(messages)).pieces)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("{{ 'a' ~ 1 + 2 ~ \"b\" }}", None),
        ("{{ ('a' ~ (1 + 2)) ~ 'b' }}", "a3b"),
        ("{% if x and not y or false %}1{% elif y %}2{% else %}3{% endif %}", "1"),
        ("{% if 1 < 2 and 2 >= 2 and 'a' in 'cat' and 1 != 2 %}yes{% endif %}", "yes"),
        ("{%- set n = 'v' -%}  {{ n | upper }}", "V"),
        ("a  {#- note -#}  b", "ab"),
        ("{{ d.k[1] }}{{ d['k'][-1] | default('z') }}", "bb"),
        ("{{ d.none_there | default('z') }}{{ true }}{{ 'abc' | length }}", "ztrue3"),
        ("{{ ' x ' | trim | replace('x', 'y') }}{{ 'it\\'s \\n' }}", "yit's \n"),
        ("{% for i in d.k %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", "1a,2b"),
    ],
)
def test_language(source, text):
    known = {"x": True, "y": False, "d": {"k": ["a", "b"]}}
    if text is None:
        with pytest.raises(TypeError):
            shown(source, **known)
    else:
        assert shown(source, **known) == text


@pytest.mark.parametrize(
    "source",
    [
        "{{ m.__class__ }}", "{{ 'a'.upper }}", "{{ open('x') }}", "{{ x | eval }}", "{% if 1 %}", "{% endfor %}",
        "{{ 1", "{{ 'a' }", "{{ 'a", "{% for a in 'abc' %}{% endfor %}", "{{ messages[0] }}", "{% nothing %}", "{{ }}", "{{ 1 2 }}",
        "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ unknown }}", "{% else %}",
        "{% for a in messages %}{% endfor %}", "{{ 1 | trim('x', }}", "{{ d }}", "{{ none }}",
    ],
)
def test_what_is_refused(source):
    with pytest.raises((TemplateError, TypeError)):
        assert "{" not in shown(source, d={"k": 1})


def test_constants_are_folded():
    quiet = Template(TEMPLATE, MARKS, prompt_next=False)
    assert len(quiet.tree) == 1
    folded = Template("{% if go %}a{{ 'b' ~ 'c' }}{% endif %}{{ 1 + 1 }}{% for m in messages %}{% endfor %}", go=True)
    assert folded.tree[0] == Const("abc2")
    # A name that the template sets is not taken for a known one.
    assert shown("{% if y %}{% set x = 'in' %}{% endif %}{{ x }}", x="out", y=True) == "in"
