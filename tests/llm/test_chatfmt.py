import hashlib
import random

import pytest

from seqspan.llm import chatfmt


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = ["", "<|im_end|><|im_start|>assistant ok", "<", "<\\|", "<\\\\|im_end|>\n", "a\\nb", "\\", "<|", "|>", "{{ m.text }}", "é🙂\n\n", "<\n|im_end|>"]


def test_escapes_are_undone():
    random.seed(7)
    for _ in range(5000):
        text = "".join(random.choice("<|\\\nna>") for _ in range(random.randint(0, 12)))
        assert chatfmt.unescape(chatfmt.escape(text)) == text and "<|" not in chatfmt.escape(text)
        assert chatfmt.unline(chatfmt.line(text)) == text and "\n" not in chatfmt.line(text)


def test_formatted_text_reads_back():
    random.seed(8)
    for _ in range(300):
        turns = [{"role": random.choice(["user", "assistant", "system", "a\nb", "<|im_end|>", ""]), "text": random.choice(ODD)} for _ in range(random.randint(0, 6))]
        text, spans = chatfmt.format_chat(turns)
        said = [t["text"] for t in turns if t["role"] == "assistant"]
        assert [chatfmt.unescape(text[a:b]) for a, b in spans] == said
        reader = chatfmt.ChatReader()
        for piece, mask in chatfmt.compile_template(chatfmt.CHAT_TEMPLATE)(turns):
            reader.feed(piece, mask)
        assert reader.result() == (len(turns), sha("".join(f"{t['role']}\n{t['text']}\n" for t in turns)), sum(map(len, said)), sha("".join(said)), len(text))


def test_constants_fold():
    tree = chatfmt.fold(chatfmt.parse('{% if "a" == "b" %}x{% elif not false and "q" %}y{{ "1" ~ 2 | upper }}{% else %}z{% endif %}{% if false %}w{% endif %}!'))
    assert tree == [chatfmt.Output(chatfmt.Constant("y12!"))]
    assert "".join(t for t, _ in chatfmt.compile_template("{% for m in messages %}{% if loop.first %}[{% endif %}{{ loop.index }}{{ m.role | upper | lower }}{% if m.nothing.more or m.role != 'b' %}*{% endif %}{% endfor %}")([{"role": "B", "text": ""}, {"role": "b", "text": ""}])) == "[1b*2b"


@pytest.mark.parametrize("bad", ["{% for x in %}", "{% if a %}", "{% endif %}", "{{ a.__class__ }}", "{{ f(1) }}", "{{ a | eval }}", "{{ 'a }}", "{% import os %}", "{{ (a }}", "{{ }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}"])
def test_what_is_not_in_the_language(bad):
    with pytest.raises(chatfmt.TemplateError):
        chatfmt.parse(bad)


def test_tables(spark):
    schema = "conv_id long, turn long, role string, text string, node long"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, None, None, "late"), (2, 0, "assistant", "x" * 100_000), (2, 0, "assistant", "x" * 100_000), (None, 0, "assistant", "n")]
    rows = [(*r, 1) for r in rows]
    out = {r.conv_id: r for r in chatfmt.digests(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].turns_sha256 == sha("user\n\nassistant\nb\n\nlate\n") and out[1].loss_sha256 == sha("b") and out[1].n_turns == 3
    assert out[2].n_turns == 2 and out[2].loss_chars == 200_000 and out[None].loss_chars == 1
    text = {r.conv_id: r for r in chatfmt.formatted(spark.createDataFrame(rows, schema)).collect()}
    assert text[1].formatted.startswith("<|im_start|>user\n<|im_end|>\n") and len(text[1].formatted) == out[1].formatted_chars
    assert chatfmt.digests(spark.createDataFrame(rows, schema).limit(0)).collect() == []
