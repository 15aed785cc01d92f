import hashlib
import random

import pytest

from siftmark.llm import chat


def digest(rows):
    h, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
    for role, text in rows:
        h.update(f"{role or ''}\n{text or ''}\n".encode())
        if role == "assistant":
            loss.update((text or "").encode())
            chars += len(text or "")
    return len(rows), h.hexdigest(), chars, loss.hexdigest()


def texts(rng):
    parts = [*chat.CONTROLS, "\\", "[", "<", "/INST]", "\\b", "\\o", "é🙂", " ", "\n", "plain", "]", "INST]", "s>", "TEXT]", "{{ m }}"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(1)
    for _ in range(5000):
        text = texts(rng)
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_round_trip(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "tool[TEXT]", "", None]
    convs = {i: [(rng.choice(roles), rng.choice([None, texts(rng)])) for _ in range(rng.randint(1, 9))] for i in range(60)}
    convs[None] = [("user", "no id")]
    rows = [(c, t, r, x, "extra") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.read_back(chat.formatted(table)).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == {c: digest(t) for c, t in convs.items()}


def test_repeated_turns_and_empty_table(spark):
    table = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.formatted(table)).first()
    assert tuple(got)[1:5] == digest([("assistant", "b"), ("user", "a"), ("user", "a")])
    assert chat.read_back(chat.formatted(table.where("false"))).count() == 0


def test_long_conversation_is_streamed(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(5000)]
    table = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.formatted(table)
    assert out.count() == 5000
    assert tuple(chat.read_back(out).first())[1:5] == digest(turns)


def test_language():
    messages = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "Yo"}]
    def run(source):
        return "".join(p for p, _ in chat.compile_template(source)(iter(messages)))
    assert run("{# note #}a{% for m in messages %}{{ m.role | upper }}:{{ m.text | trim }};{% endfor %}z") == "aUSER:Hi;ASSISTANT:Yo;z"
    assert run("{% if 'a' == 'b' %}x{% elif not false and ('c' != 'd') %}y{% else %}w{% endif %}{{ 'p' + 'q' }}") == "ypq"
    spans = [p for p in chat.compile_template("{% for m in messages %}{% generation %}{{ m.text }}{% endgeneration %}|{% endfor %}")(iter(messages))]
    assert spans == [(" Hi ", True), ("|", False), ("Yo", True), ("|", False)]


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if true %}d{% else %}{{ 'e' }}{% endif %}{% if 'x' == 'y' %}f{% endif %}"))
    assert tree == [chat.Out(chat.Const("abcd"))]


@pytest.mark.parametrize("source", ["{{ os }}", "{{ messages.__class__ }}", "{{ m.text }}", "{% for m in messages %}", "{{ 'a' | eval }}", "{% import x %}", "{{ messages() }}", "{% if true %}a"])
def test_what_is_not_allowed_fails_at_compile_time(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)
