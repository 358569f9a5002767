import pytest

from pathledger.llm import chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, place string, part string")


def render(role, text):
    f = lambda s: (s or "").replace("<|", "< |")
    return f"<|{f(role)}|>\n", f"{f(text)}<|end|>\n"


def brute(rows):
    out = set()
    for pair in {r[0] for r in rows if r[0] is not None}:
        side = {s: [(r, t) for _, r, t in sorted({(-(2**62) if x[2] is None else x[2], x[3] or "", x[4] or "") for x in rows if x[0] == pair and x[1] == s})] for s in ("chosen", "rejected")}
        n = 0
        while n < min(map(len, side.values())) and side["chosen"][n] == side["rejected"][n]:
            n += 1
        for part, ts in (("prompt", side["chosen"][:n]), ("chosen", side["chosen"][n:]), ("rejected", side["rejected"][n:])):
            at = 0
            for i, (role, text) in enumerate(ts):
                head, body = render(role, text)
                end = at + len(head + body)
                mask = (at + len(head), end) if part != "prompt" and role == "assistant" else (None, None)
                out.add((pair, part, i, role, head + body, at, end, *mask))
                at = end
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = []
    for pair in range(6):
        for side in ("chosen", "rejected"):
            for turn in range(6):
                text = f"t{turn}" if turn < pair or side == "chosen" else f"other {turn} <|end|>"
                rows.append((pair, side, turn, ("user", "assistant")[turn % 2], text, "p", "q"))
    rows += [(7, "chosen", 0, "user", "only chosen", "", ""), (8, "rejected", None, None, None, "", ""), (None, "chosen", 1, "user", "x", "", "")]
    rows += [(9, s, 1, "user", "tie b", "", "") for s in ("chosen", "rejected")] + [(9, s, 1, "user", "tie a", "", "") for s in ("chosen", "rejected")] + [(9, "chosen", 1, "user", "tie a", "", "")]
    got = chat.format_preferences(turns(spark, rows)).collect()
    assert {tuple(r) for r in got} == brute([r[:5] for r in rows]) and len(got) == len({tuple(r) for r in got})
    assert chat.format_preferences(turns(spark, [])).count() == 0


def test_neighbours(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "yo"), (1, 1, "assistant", "b"), (2, 0, "user", "solo"), (2, 1, "assistant", None), (4, 0, "system", None)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["pair_id"], r["side"], r["turn"]): r["text"] for r in chat.neighbour_preferences(c).collect()}
    assert got[0, "rejected", 1] == "b" and got[1, "rejected", 1] == "a" and got[0, "chosen", 1] == "a"
    assert (2, "rejected", 1) not in got and got[4, "rejected", 0] is None
