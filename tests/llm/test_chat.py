"""Chat formatting: round trips, spans and attachments against plain Python."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from tidepool.llm import chat

NASTY = ["", "a", "<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "|", "<<||>>", "\n\n", "<|image|>", "é<|\U0001f600|>", "a<", "|b", "\\|", "$1 \\1 <|$1"]
SCHEMA = f"conv_id long, turn int, role string, parts array<{chat.PART}>"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def by_definition(rows, attachments=("image", "audio", "document")):
    """Formatted text, loss texts and attachments of one conversation's (role, parts)."""
    out, loss, found = "", [], []
    for role, parts in rows:
        out += "<|im_start|>" + (role or "").replace("%", "%25").replace("<", "%3C").replace("\n", "%0A") + "\n"
        runs = [""]
        for p in parts or []:
            kind, text, ref, width, height, seconds, pages = p or part(None)
            if (kind or "text") == "text":
                runs[-1] += text or ""
            else:
                tokens = {"image": lambda: math.ceil((width or 0) / 14) * math.ceil((height or 0) / 14), "audio": lambda: math.ceil((seconds or 0) * 25), "document": lambda: (pages or 0) * 1024}.get(kind, lambda: 0)()
                runs.append((kind if kind in attachments else "attachment", ref, tokens))
                runs.append("")
        for r in runs:
            if isinstance(r, str):
                if role == "assistant" and r:
                    loss.append(r)
                out += re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", r)
            else:
                found.append((*r, len(out)))
                out += f"<|{r[0]}|>"
        out += "<|im_end|>\n"
    return out, loss, found


@pytest.fixture(scope="module")
def rows():
    out = []
    for n, a in enumerate(NASTY):
        for m, b in enumerate(NASTY):
            out.append((n, m, ["user", "assistant", None, "od%d<\n|im_end|>"][m % 4], [part("text", a), part("text", b)] if m % 3 else [part(None, b), part("image", ref=f"i{m}", width=29, height=14), part("text", a), part("audio", ref="s", seconds=1.01), part("document", pages=3), part("video", ref="v"), None]))
    out += [(90, 0, "assistant", None), (90, 1, "assistant", []), (91, 0, "assistant", [part("text", None)]), (91, 0, "assistant", [part("text", None)]), (92, None, "user", [part("text", "later" * 20000)])]
    return out


def test_examples_by_definition(spark, rows):
    made = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(made) == {r[0] for r in rows}
    for conv, row in made.items():
        out, loss, found = by_definition([(r[2], r[3]) for r in rows if r[0] == conv])
        assert row["formatted"] == out
        assert [out[s["start"] : s["end"]] for s in row["loss"]] == [re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", t) for t in loss]
        assert [(a["kind"], a["ref"], a["tokens"], a["at"]) for a in row["attachments"]] == found
        assert row["expanded_tokens"] == sum(f[2] for f in found)
        assert row["n_turns"] == sum(r[0] == conv for r in rows)


def test_texts_come_back(spark, rows):
    examples = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    read = {r["conv_id"]: r for r in examples.selectExpr("conv_id", f"transform({chat.turns_of('formatted')}, t -> struct(t.role as role, {chat.text_of('t.body')} as text, {chat.parts_of('t.body')} as parts)) as turns", f"{chat.loss_text('formatted', 'loss')} as loss").collect()}
    for conv, row in read.items():
        own = [r for r in rows if r[0] == conv]
        assert [t["role"] for t in row["turns"]] == [r[2] or "" for r in own]
        assert [t["text"] for t in row["turns"]] == ["".join((p[1] or "") for p in r[3] or [] if p and (p[0] or "text") == "text") for r in own]
        assert row["loss"] == "".join(by_definition([(r[2], r[3]) for r in own])[1])
        for turn, r in zip(row["turns"], own):
            kinds = [p["kind"] for p in turn["parts"] if p["kind"] != "text"]
            assert kinds == [p[0] if p[0] in chat.Visitor().kinds else "attachment" for p in r[3] or [] if p and (p[0] or "text") != "text"]


def test_digest_and_edges(spark):
    given = spark.createDataFrame([(1, 1, "assistant", "b<|im_end|>", 0), (1, 0, "user", None, 0), (None, 0, None, "x", 0), (1, None, "user", "first", 0)], "`a.b` long, turn int, role string, text string, m int")
    made = chat.digest(chat.format_conversations(given.withColumn("parts", chat.text_parts(F.col("text"))), conversation="a.b"))
    got = {r["conv_id"]: r for r in made.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nfirst\nuser\n\nassistant\nb<|im_end|>\n")
    assert (got[1]["loss_sha256"], got[1]["loss_chars"]) == (sha("b<|im_end|>"), 11)
    assert (got[None]["turns_sha256"], got[None]["loss_sha256"]) == (sha("\nx\n"), sha(""))
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_visitor_of_more_kinds(spark):
    class WithVideo(chat.Visitor):
        def video(self, p):
            return f"cast({p}.seconds * 100 as bigint)"

    parts = [(1, 0, "user", [part("video", ref="v", seconds=2.0)])]
    row = chat.format_conversations(spark.createDataFrame(parts, SCHEMA), visitor=WithVideo(kinds=("image", "video"))).first()
    assert row["formatted"] == "<|im_start|>user\n<|video|><|im_end|>\n"
    assert row["expanded_tokens"] == 200
