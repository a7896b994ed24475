"""Transcript parsing and chat formatting by a hidden Markov model.

A raw transcript is a run of lines in which speakers are marked in many ways, or not at all.
Its hidden states say who speaks and whether the line begins a turn; each line shows a
speaker marker (whose, and whether of the transcript's own style), whether a blank line stands before it, how it opens and
ends, and its length. The model is fitted by counting over labelled transcripts, with smoothing
that trusts explicit markers; Viterbi decoding recovers the roles, all transcripts of a batch side by side.
Recovered turns are rendered canonically as ``<|role|>``, the text, ``<|end|>``.

A transcript's style is that of the marker at its head, or else the most frequent one. Markers of another style are
hardly evidence: in a transcript of ``User:`` and ``Assistant:``, the lines ``A) red`` and ``Q: why`` are text. Only a marker of
the role and style that begin a turn is taken off; all other text is kept as it stands, blank lines and indents included,
but for blank lines at the ends of a turn. Speakers other than system, user and assistant, by the names in ``OTHERS`` and those met in training, keep their names.

The model learns from at most about ``train_conversations`` conversations, drawn by a hash of
the id. The table holds turns with known roles, so transcripts are first written out from them in varying
styles: names, tags, letters, numbered headings, and some turns without marker or blank line.

Edge cases: null texts are empty turns and null roles are written without a marker; null turn
numbers come first; ties and repeated rows are turns in the order of role and text; null ids form
one conversation; a conversation without any line has no turns; very long ones are decoded whole; with nothing to learn
from, markers alone decide; a role named by an unknown name without a marker of its own goes to a known one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm._text import table

ROLES = ("system", "user", "assistant")
OTHER = len(ROLES)
OTHERS = ("tool", "function", "observation", "environment", "developer", "moderator", "narrator", "critic")
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: ", None: "{}: "},
    {"system": "[System] ", "user": "[Human] ", "assistant": "[AI] ", None: "[{}] "},
    {"system": "### Instructions\n", "user": "### Question\n", "assistant": "### Answer\n", None: "### {}\n"},
    {"system": "<sys> ", "user": "<me> ", "assistant": "<bot> ", None: "<{}> "},
    {"system": "S: ", "user": "Q: ", "assistant": "A: ", None: "{}: "},
    {"system": "**system** ", "user": "**user** ", "assistant": "**model** ", None: "**{}** "},
)
NAMES = {
    "system": "system instruction instructions sys context s",
    "user": "user human question customer me you prompter client q",
    "assistant": "assistant ai answer bot model gpt agent chatbot a",
}
ROLE_OF = {name: ROLES.index(role) for role, names in NAMES.items() for name in names.split()}
#: A word or two in the dress of a marker; each way to dress it is a style.
SHAPE = re.compile(r"(?:\[ ?(?P<square>[\w-]+) ?\]:?|<(?P<angle>[\w-]+)>:?|\((?P<round>[\w-]+)\):?|\*\*(?P<star>[\w-]+):?\*\*:?|#+ ?(?P<head>[\w-]+):?(?=[ \t]*$)|(?P<letter>[A-Za-z]):(?=\s|$)|(?P<paren>[\w-]+)\)(?=\s|$)|(?P<name>[\w-]{2,}):(?=\s|$))[ \t]?")
N_STATES = 2 * (len(ROLES) + 1)  # role * 2 + (0: begins a turn, 1: goes on)
BARE = 1 + 2 * (len(ROLES) + 1)  # no marker, but a blank line before
N_MARKERS = BARE + 1  # none, of the own style for each role, of another style for each, none after a blank line
OPEN = 0.2
SIZES = (N_MARKERS, 2, 3, 3, 4)  # marker, blank before, opening, ending, length
SCHEMA = "conv_id BIGINT, n_lines INT, n_turns INT, roles ARRAY<STRING>, chat STRING, log_likelihood DOUBLE"
OUT = pa.schema([("conv_id", pa.int64()), ("n_lines", pa.int32()), ("n_turns", pa.int32()), ("roles", pa.list_(pa.string())), ("chat", pa.string()), ("log_likelihood", pa.float64())])

Line = tuple[str, list[str]]  # with the blank lines before it


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    shows: list[np.ndarray]  # for each feature, states x values
    others: frozenset[str] = field(default=frozenset(OTHERS))


def split_marker(line: str, others: frozenset[str] = frozenset(OTHERS)) -> tuple[str, str, str] | None:
    """(style, name, the line without it) of a marker at the head of the line that names a speaker."""
    m = SHAPE.match(line)
    if not m:
        return None
    style = m.lastgroup or ""
    name = m[style].lower()
    return (style, name, line[m.end() :]) if name in ROLE_OF or name in others else None


def own_style(marks: list[tuple[str, str, str] | None]) -> str | None:
    """The style at the head, or else the most frequent one, the first of equals."""
    if marks and marks[0]:
        return marks[0][0]
    found = Counter(m[0] for m in marks if m)
    return max(found, key=lambda k: found[k]) if found else None


def marked(lines: list[Line], others: frozenset[str] = frozenset(OTHERS)) -> list[tuple[int, str, str]]:
    """For each line the marker's value as a feature, the speaker's name and the text behind it."""
    marks = [split_marker(line, others) for line, _ in lines]
    style, out = own_style(marks), []
    for (line, _), m in zip(lines, marks):
        if m is None:
            out.append((0, "", line))
        else:
            role = ROLE_OF.get(m[1], OTHER)
            out.append((1 + role + (0 if m[0] == style else len(ROLES) + 1), m[1] if role == OTHER else ROLES[role], m[2]))
    return out


def features(lines: list[Line], others: frozenset[str] = frozenset(OTHERS)) -> np.ndarray:
    """What each line shows."""
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    for i, ((_, blank), (marker, _, rest)) in enumerate(zip(lines, marked(lines, others))):
        text = rest.strip()
        opening = 2 if not text or not text[0].isalpha() else int(text[0].islower())
        ending = 2 if text.endswith("?") else int(text.endswith((".", "!", ":")))
        out[i] = BARE if not marker and blank else marker, int(bool(blank)), opening, ending, min(3, len(text).bit_length() // 3)
    return out


def lines_of(transcript: str) -> list[Line]:
    """The lines that aren't blank, each with the blank ones before it."""
    out: list[Line] = []
    blank: list[str] = []
    for line in transcript.split("\n"):
        if line.strip():
            out.append((line, blank))
            blank = []
        else:
            blank.append(line)
    return out


def write_out(turns: list[tuple[str | None, str]], key: int, bare_share: float = 0.1, tight_share: float = 0.15) -> tuple[str, list[int]]:
    """A transcript of the turns in a style set by the key, and the state of each line that isn't blank."""
    rng = np.random.default_rng(abs(key))
    style = STYLES[int(rng.integers(len(STYLES)))]
    draws = rng.random((len(turns) + 1, 2))
    bare = [role is None or (i > 0 and draws[i, 0] <= bare_share) for i, (role, _) in enumerate(turns)]
    pieces, states = [], []
    for i, (role, text) in enumerate(turns):
        mark = "" if bare[i] else style.get(role) or style[None].format(role)
        body = mark + text
        n = len(lines_of(body))
        if n:
            r = 2 * (ROLES.index(role) if role in ROLES else OTHER if mark else 1)
            states += [r] + [r + 1] * (n - 1)
        pieces.append(body)
        if i + 1 < len(turns):
            pieces.append("\n" if draws[i, 1] < tight_share and not bare[i + 1] else "\n\n")
    return "".join(pieces), states


def fit(examples: list[tuple[np.ndarray, list[int]]], others: frozenset[str] = frozenset(OTHERS)) -> Model:
    """Counts over labelled lines. The smoothing says that markers of the own style are right and others are text, and alone decides without examples."""
    start, move = np.ones(N_STATES), np.ones((N_STATES, N_STATES))
    start[1::2] = 1e-6  # a transcript begins with a turn
    for s in range(N_STATES):
        for t in range(1, N_STATES, 2):
            if t // 2 != s // 2:
                move[s, t] = 1e-6  # only a turn of one's own goes on
    shows = [np.ones((N_STATES, n)) for n in SIZES]
    for r in range(len(ROLES) + 1):
        begin, on = shows[0][2 * r], shows[0][2 * r + 1]
        # Speakers of other names have to be named.
        weak = 1e-4 if r < OTHER else 1e-12
        begin[:] = [weak] + [1e-12] * (len(ROLES) + 1) + [weak] * (len(ROLES) + 1) + [1e4 * weak]
        begin[1 + r] = 20.0
        on[:] = [60.0] + [1e-10] * (len(ROLES) + 1) + [1.0] * (len(ROLES) + 1) + [10.0]
    for f, states in examples:
        s = np.array(states, np.int64)
        if not len(s):
            continue
        start[s[0]] += 1
        np.add.at(move, (s[:-1], s[1:]), 1)
        for j, table_ in enumerate(shows):
            np.add.at(table_, (s, f[:, j]), 1)
    shares = [x / x.sum(axis=1, keepdims=True) for x in shows]
    # How a line opens, ends and how long it is may be otherwise in other texts, so a part of it is left open.
    shares[2:] = [(1 - OPEN) * x + OPEN / x.shape[1] for x in shares[2:]]
    return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), [np.log(x) for x in shares], others)


def viterbi(seen: list[np.ndarray], model: Model) -> tuple[list[np.ndarray], np.ndarray]:
    """The likeliest states of each sequence and their log-probability; ties go to the lower state."""
    order = sorted(range(len(seen)), key=lambda i: -len(seen[i]))
    n = np.array([len(seen[i]) for i in order])
    paths: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seen)
    score = np.zeros(len(seen))
    live = int((n > 0).sum())
    if not live:
        return paths, score
    offset = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate([seen[i] for i in order[:live]])
    emit = sum(t[:, flat[:, j]].T for j, t in enumerate(model.shows))
    back = np.zeros((len(flat), N_STATES), np.int8)
    best = model.start + emit[offset[:live]]
    last = np.empty((live, N_STATES))
    for t in range(1, int(n[0]) + 1):
        now = int((n[:live] > t).sum()) if t < n[0] else 0
        last[now : len(best)] = best[now:]
        if not now:
            break
        ways = best[:now, :, None] + model.move[None]
        back[offset[:now] + t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + emit[offset[:now] + t]
    state, final = last.argmax(axis=1), last.max(axis=1)
    for row in range(live):
        path, s = np.empty(n[row], np.int64), int(state[row])
        for t in range(n[row] - 1, -1, -1):
            path[t] = s
            s = int(back[offset[row] + t, s])
        paths[order[row]], score[order[row]] = path, final[row]
    return paths, score


def render(lines: list[Line], marks: list[tuple[int, str, str]], states: np.ndarray) -> tuple[list[str], str]:
    """The roles of the turns, and the canonical chat. Of the text nothing but the markers of the turns is taken off."""
    roles: list[str] = []
    turns: list[list[str]] = []
    for (line, blank), (marker, name, rest), s in zip(lines, marks, states.tolist()):
        role = s // 2
        if s % 2 == 0 or not turns:
            told = marker == 1 + role
            roles.append(name if told else ROLES[min(role, OTHER - 1)])
            turns.append([rest if told else line] if rest.strip() or not told else [])
        else:
            turns[-1] += [*blank, line] if turns[-1] else [line]
    return roles, "".join(f"<|{r}|>\n{chr(10).join(t)}\n<|end|>\n" for r, t in zip(roles, turns))


def parse(transcripts: list[str], model: Model) -> Iterator[tuple[int, list[str], str, float]]:
    """(lines, roles of the turns, canonical chat, log-likelihood) of each transcript."""
    lines = [lines_of(t) for t in transcripts]
    paths, score = viterbi([features(x, model.others) for x in lines], model)
    for x, path, s in zip(lines, paths, score):
        roles, chat = render(x, marked(x, model.others), path)
        yield len(x), roles, chat, float(s)


def gather(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("role").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _in_order).alias("turns"))


def _in_order(a, b):
    """Nulls first, then by number, role and text."""
    step = F.lit(0)
    for f in ("text", "role", "turn"):
        x, y = a[f], b[f]
        step = F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(step)
    return step


def _turns(value: list[dict]) -> list[tuple[str | None, str]]:
    return [(t["role"], t["text"]) for t in value]


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, transcript): the conversations written out, as found in the wild."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [write_out(_turns(t), k or 0)[0] for k, t in zip(b["conv_id"].to_pylist(), b["turns"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["conv_id"], pa.array(texts, pa.string())], names=["conv_id", "transcript"])

    return gather(conversations).mapInArrow(run, "conv_id BIGINT, transcript STRING")


def train(conversations: DataFrame, train_conversations: int) -> Model:
    n = conversations.select("conv_id").distinct().count()
    share = F.pmod(F.xxhash64(F.col("conv_id").cast("bigint"), F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    rows = gather(conversations.where(share <= train_conversations / max(1, n))).orderBy("conv_id").collect()
    others = frozenset(OTHERS) | {t["role"].lower() for r in rows for t in r["turns"] if t["role"] and re.fullmatch(r"[\w-]+", t["role"])} - ROLE_OF.keys()
    examples = []
    for r in rows:
        text, states = write_out([(t["role"], t["text"]) for t in r["turns"]], r["conv_id"] or 0)
        examples.append((features(lines_of(text), others), states))
    return fit(examples, others)


def format_chats(transcripts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, n_lines, n_turns, roles, chat, log_likelihood) of (conv_id, transcript)."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(parse([t or "" for t in b["transcript"].to_pylist()], shared.value))
            n, roles, chat, score = zip(*rows) if rows else ((), (), (), ())
            cols = (n, [len(r) for r in roles], roles, chat, score)
            yield pa.RecordBatch.from_arrays([b["conv_id"], *(pa.array(c, f.type) for c, f in zip(cols, list(OUT)[1:]))], schema=OUT)

    return transcripts.select(F.col("conv_id").cast("bigint").alias("conv_id"), "transcript").mapInArrow(run, SCHEMA)


def op8_chat_format(spark: SparkSession, sf_dir: str, train_conversations: int = 1000) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return format_chats(raw_transcripts(talks), train(talks, train_conversations))
