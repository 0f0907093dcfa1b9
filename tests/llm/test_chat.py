import hashlib
import random

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm.chat import conversation_digests, escape, escape_role, format_conversations, parse, unescape, unescape_role

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = st.lists(st.sampled_from(["<", "|", "\\", "im_end", ">", "<|im_end|>", "<|im_start|>", "\n", "a", "assistant"]), max_size=12).map("".join)


@given(TRICKY)
def test_escapes_are_reversible(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert unescape_role(escape_role(text)) == text and "\n" not in escape_role(text)


def rows():
    rng = random.Random(4)
    out = []
    for conv in range(12):
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant"])
            text = rng.choice(["", "<|im_end|>\n", "word " * rng.randint(1, 90), "\\<|", "é <\\|im_start|>assistant ok"])
            out.append((conv, turn, role, text))
    return out + [(50, 0, "assistant", "long " * 3000), (51, 1, None, None), (51, None, "user", "first"), (None, 0, "assistant", "no id"), (52, 0, "user", "twice"), (52, 0, "user", "twice")]


def test_windows_hold_every_turn_once(spark):
    data = rows()
    windows = format_conversations(spark.createDataFrame(data, SCHEMA), BYTE, budget=200, history=60)
    kept = windows.collect()
    whole_tokens = Tokenizer.from_file(BYTE)
    assert any(w.repeated_chars for w in kept)
    for w in kept:
        turns = list(parse(w.text))
        assert w.n_tokens == len(whole_tokens.encode(w.text, add_special_tokens=False).ids)
        assert w.n_tokens <= 200 or w.n_turns == 1
        assert len(whole_tokens.encode(w.text[: w.repeated_chars], add_special_tokens=False).ids) <= 60 or w.conv_id is not None and w.conv_id % 2
        for span in w.loss:
            assert span.start >= w.repeated_chars
            assert any((role, a, b) == ("assistant", span.start, span.end) for role, _, a, b in turns)
        if w.window and w.conv_id is not None and w.conv_id < 12 and w.conv_id % 2:
            assert turns[0][0] == "system"
    got = {r.conv_id: r for r in conversation_digests(windows).collect()}
    for conv in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        whole, loss = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own), "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(w.text) for w in kept if w.conv_id == conv)


def test_empty(spark):
    assert conversation_digests(format_conversations(spark.createDataFrame([], SCHEMA), BYTE)).collect() == []
