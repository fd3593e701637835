"""Chat windows: read back exactly, within their budget, each target once."""

import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silvatide.llm import chat_format as c
from silvatide.llm.token_output import tokenizer_path

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NASTY = st.text(st.sampled_from(list("\\#</turn> :\n\rabÄ\x00")), max_size=40)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
def test_escapes_are_reversible(turns):
    text = "".join(c.formatted(r, t) for r, t in turns)
    assert c.parsed(text) == turns
    for r, t in turns:
        assert c.unescaped(c.escaped(t)) == t and "##" not in c.escaped(t) and "</turn>" not in c.escaped(t)
        assert c.head(r).count("###") == 1 and "</turn>" not in c.head(r)


def test_other_texts_are_refused():
    for text in ("x", "### a: b", "### a: b </turn>\n x", "a: b </turn>\n", "### a </turn>\n"):
        with pytest.raises(ValueError):
            c.parsed(text)


def in_order(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {k: [(r, t) for *_, r, _, t in sorted(v)] for k, v in convs.items()}


def brute(rows):
    out = []
    for conv, turns in in_order(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(seed, conv, n, system=True, longest=40):
    r = random.Random(seed)
    words = ["so", "###", "</turn>", "\\", "#", "is", "the", "Ärger", "weather", ": ", "\n", "😀"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, longest)))
    return [(conv, k, "system" if system and k == 0 else ("user", "assistant")[k % 2], text()) for k in range(n)]


CASES = {
    "talks": [x for k in range(6) for x in talk(k, k, k * 7 + 1, k % 2 == 0)],
    # One conversation with most of the rows, over several blocks.
    "hot": talk(9, 1, 1500, longest=12) + talk(10, 2, 3) + talk(11, 3, 1100, False, 6),
    "edges": [(None, None, None, None), (None, 1, "assistant", ""), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "a:### </turn>", "c"), (5, None, "system", "late"), (6, 0, "system", "long " * 3000), (6, 1, "user", "hello"), (6, 2, "assistant", "wort " * 30000), (6, 3, "assistant", None)]
    + [(7, 4, "assistant", "same")] * 30 + [(8, 0, "system", "only")],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_windows(spark, name):
    rows = CASES[name]
    budget, history, block = (120, 40, 100) if name != "talks" else (200, 0, 512)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = c.windows(df, tokenizer_path(), budget, history, block)
    got = sorted((tuple(r)[:5] for r in c.digests(made).collect()), key=repr)
    assert got == brute(rows)
    want = in_order(rows)
    loss = {}
    for w in sorted(made.collect(), key=lambda w: w.first_turn):
        turns, all_turns = c.parsed(w.text), want[w.conv_id]
        new, before = turns[w.n_repeated :], turns[: w.n_repeated]
        assert new == all_turns[w.first_turn : w.first_turn + w.n_new]
        # The system turn is in every window; what else is repeated are the last turns before the new ones.
        if w.first_turn and all_turns[0][0] == "system":
            assert before[0] == all_turns[0]
            before = before[1:]
        assert before == all_turns[w.first_turn - len(before) : w.first_turn]
        assert w.tokens <= budget or w.n_new == 1 and not before
        spans = [w.text[a:b] for a, b in zip(w.loss_start, w.loss_end, strict=True)]
        assert [c.unescaped(s) for s in spans] == [t for r, t in new if r == "assistant"]
        loss.setdefault(w.conv_id, []).extend(spans)
    read = sorted(((r.conv_id, r.pos, r.role, r.text, r.under_loss) for r in c.read_turns(made).collect()), key=repr)
    assert read == sorted(((k, i, r, t, r == "assistant") for k, v in want.items() for i, (r, t) in enumerate(v)), key=repr)
    chars = {r.conv_id: r.formatted_chars for r in c.digests(made).collect()}
    assert chars == {r[0]: r[1] for r in made.groupBy("conv_id").agg(F.sum(F.length("text"))).collect()}


def test_windows_are_full():
    """No window could have taken the next turn; history is as long as it may be."""
    import numpy as np

    tokens = np.array([random.Random(k).randint(5, 60) for k in range(400)])
    for start, system in ((0, 0), (0, None), (30, 0), (30, None)):
        chosen = c._chosen(tokens, start, system, 200, 64)
        assert [x[2] for x in chosen] == [start] + [x[3] for x in chosen[:-1]] and chosen[-1][3] == 400
        for again, lo, s, end in chosen:
            used = tokens[lo:end].sum() + (tokens[0] if again else 0)
            assert used <= 200 and (end == 400 or used + tokens[end] > 200)
            assert tokens[lo:s].sum() <= 64 and (lo <= (system is not None) or tokens[lo - 1 : s].sum() > 64)


def test_clashing_columns_and_empty(spark):
    rows = CASES["talks"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("x"), "part": F.lit(1), "tokens": F.lit(None), "block": F.lit(2), "n": F.lit(3)})
    made = c.windows(df.select("n", "text", "pos", "role", "turn", "part", "conv_id", "tokens", "block"), tokenizer_path())
    assert sorted((tuple(r)[:5] for r in c.digests(made).collect()), key=repr) == brute(rows)
    none = c.windows(spark.createDataFrame([], SCHEMA), tokenizer_path())
    assert c.digests(none).count() == 0 and c.read_turns(none).count() == 0
    with pytest.raises(ValueError):
        c.windows(df, tokenizer_path(), 100, 100)


def test_query(spark, sf):
    """All conversations and the added one."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    out = c.op11_chat_formatting(spark, sf)
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted((tuple(r)[:5] for r in out.collect()), key=repr) == brute(rows)
