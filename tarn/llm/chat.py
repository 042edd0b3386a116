"""Chat formatting in budgeted windows.

Token counts of formatted turns, marks and escapes included, add up to prefix sums; a window is a span of whole turns
whose sum fits the budget. Each window
repeats the conversation's system turn and a limited history of the turns before it; repeated turns are out of
the loss, so each assistant text is a target once. Turns are marked by control strings, which texts can't contain:
they are escaped, and read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import in_arrow
from tarn.llm.tokens import default_path, encoder

START, END = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id bigint, window bigint, repeated int, text string, loss array<struct<begin:bigint,end:bigint>>"


def escape(text: str, *, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    """Undoes escape(); a backslash before n stands for a line break (in roles; texts never have one there)."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where the text lies in it."""
    head = f"{START}{escape(role, role=True)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parsed(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        assert text.startswith(START, at)
        line = text.index("\n", at)
        end = text.index(END, line)
        out.append((unescape(text[at + len(START) : line]), unescape(text[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return out


def costs(enc, roles: list[str], bodies: list[str]) -> list[int]:
    """How many ids each formatted turn has. Only what stands beside a mark, without white space, is encoded with it."""
    parts = [escape(t).rpartition(" ")[::2] for t in bodies]
    heads = list(dict.fromkeys(roles))
    of_head = dict(zip(heads, enc.encode([f"{START}{escape(r, role=True)}\n" for r in heads]), strict=True))
    texts, ends = enc.encode([p for p, _ in parts]), enc.encode([e + END for _, e in parts])
    return [(len(of_head[r]) + len(p) + len(e)) // 4 for r, p, e in zip(roles, texts, ends, strict=True)]


def windows(conversations: DataFrame, budget: int = 2048, history_tokens: int = 512, history_turns: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Formatted windows of conversations (conv_id, turn, role, text), in order within each conversation.

    A window takes as many further turns as fit the budget after the system turn (the first, if its role is
    system) and the repeated history: the latest up to history_turns turns of at most history_tokens together. What
    counts are the ids of the text as it is written; turns end with a line break, over which the tokenizer joins nothing,
    so turns' counts add up to the window's. A turn that exceeds the budget behind the system turn has a window with
    that turn alone, whole. `repeated` turns at a window's start are repeats; `loss` has the spans of assistant texts
    that are targets, in code points of the escaped text.

    Null role or text: empty. A row with a null conv_id is a conversation of its own. Null turns come first; rows of
    the same turn are ordered by role and text; repeated rows stay. Other columns are ignored. Of a conversation, a task
    holds one window and its history, never all turns; a conversation is one task's, as its digests and its windows need its
    turns in order.
    """
    path = tokenizer or default_path()

    def run(batches):
        enc = encoder(path)

        class Open:
            def __init__(self, conv):
                self.conv, self.number, self.system, self.system_cost = conv, 0, None, 0
                self.past: deque = deque(maxlen=max(1, history_turns))
                self.turns: list = []
                self.sum = 0
                self.history: list = []

            def close(self):
                repeats = ([self.system] if self.system and self.number else []) + [(r, t) for r, t, _ in self.history]
                parts, loss, at = [], [], 0
                for k, (role, text) in enumerate([*repeats, *((r, t) for r, t, _ in self.turns)]):
                    whole, begin, end = marked(role, text)
                    if k >= len(repeats) and role == "assistant":
                        loss.append({"begin": at + begin, "end": at + end})
                    parts.append(whole)
                    at += len(whole)
                row = (self.conv, self.number, len(repeats), "".join(parts), loss)
                self.number += 1
                self.past.extend(self.turns)
                self.history, used = [], 0
                for r, t, n in reversed(self.past) if history_turns else ():
                    if used + n > history_tokens or (self.system and (r, t) == self.system):
                        break
                    self.history.insert(0, (r, t, n))
                    used += n
                self.turns, self.sum = [], used + self.system_cost
                return row

            def add(self, role, text, cost):
                if self.system is None:
                    self.system, self.system_cost = ((role, text), cost) if role == "system" else ((), 0)
                done = self.close() if self.turns and self.sum + cost > budget else None
                while not self.turns and self.history and self.sum + cost > budget:
                    self.sum -= self.history.pop(0)[2]
                self.turns.append((role, text, cost))
                self.sum += cost
                return done

        names = [x.split()[0] for x in ("conv_id", "window", "repeated", "text", "loss")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        now, rows = None, []
        for b in batches:
            convs, roles, bodies = (b.column(k).to_pylist() for k in range(3))
            for conv, role, body, cost in zip(convs, roles, bodies, costs(enc, roles, bodies), strict=True):
                if now is None or now.conv != conv or conv is None:
                    if now:
                        rows.append(now.close())
                    now = Open(conv)
                if done := now.add(role, body, cost):
                    rows.append(done)
                if len(rows) >= 1000:
                    yield batch_of(rows)
                    rows = []
        if now:
            rows.append(now.close())
        if rows:
            yield batch_of(rows)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), text("role"), text("text"), F.col("turn").cast("bigint").alias("turn"))
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))  # such rows needn't meet
    c = c.repartition(F.col("conv_id"), spread).sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_arrow(c.select("conv_id", "role", "text"), run, WINDOWS)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation of windows(), which begins with window 0: what its formatted text says.

    n_turns and turns_sha256 leave repeats out; loss_chars and loss_sha256 are of the text under the loss spans,
    unescaped; formatted_chars counts all windows; n_windows. formatted must come straight from windows(), whose
    tasks give each conversation's windows in order: digests are fed as rows pass, so memory stays bounded.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"

    def run(batches):
        now, rows = None, []
        names = [x.split()[0] for x in schema.split(", ")]

        def row(s):
            digests = {"turns_sha256": s["turns"].hexdigest(), "loss_sha256": s["loss"].hexdigest()}
            return {"conv_id": s["conv"], "n_turns": s["n"], "loss_chars": s["chars"], "formatted_chars": s["formatted"], "n_windows": s["windows"], **digests}

        types = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
        for b in batches:
            for w in b.to_pylist():
                if now is None or w["window"] == 0:
                    if now:
                        rows.append(row(now))
                    now = {"conv": w["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0, "windows": 0}
                for role, text, _, _ in parsed(w["text"])[w["repeated"] :]:
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in w["loss"]:
                    text = unescape(w["text"][s["begin"] : s["end"]])
                    now["chars"] += len(text)
                    now["loss"].update(text.encode("utf-8", "surrogatepass"))
                now["formatted"] += len(w["text"])
                now["windows"] += 1
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, types)
                rows = []
        if now:
            rows.append(row(now))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)

    return in_arrow(formatted, run, schema)
