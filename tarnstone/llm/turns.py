"""Speech transcripts into clean speaker turns (problem 3).

A transcript is read in the layout its recorder writes (caption file, JSON lines, clocked lines, labelled lines); its
segments are swept in order of their clocks (of the text where there are none), with the latest end of all segments
begun so far, so that overlapping segments leave no silence between them; a caption that repeats the end of the one
before loses the longest suffix-prefix overlap; hesitations and sound notes are removed, and a segment with nothing else
in it is passed over; a turn ends where the speaker changes or, if asked for, at a silence that is long for this meeting.
Where a recorder writes no end, the end is where the words would be spoken at the usual pace of this meeting. Labels are
resolved among the people of the meeting only: names in any notation, initials, first names, roles and numbered speakers
of a legend.

One meeting is one row of work, and meetings are spread over the tasks by their id before they are read; people are joined
to meetings by keys, their list per meeting is as long as the meeting has participants.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnstone.llm.names import NICKNAMES, fold, name_score, parse_name

TURNS = "meeting_id long, turn_no int, person_id long, start double, text string"
# Sounds of hesitation, and fillers that are only cut out of a sentence.
HESITATIONS = r"(?:u+h+m*|u+m+|e+r+m*|h+m+|m+h*m+|a+h+|e+h+|o+h+|äh+m*|euh+|eh+m*)"
FILLERS = r"(?:you know|like)"
_NOTE = re.compile(r"\[[^\[\]\n]*+\]|\([a-z][^()\n]*+\)|<[a-z][^<>\n]*+>|\*(?!\s)[^*\n]++(?<!\s)\*|(?<![♪♫])[♪♫](?![♪♫])[^♪♫\n]++[♪♫]|[♪♫]+", re.I)
_NOTE_SIGN = re.compile(r"[\[(<*♪♫]")
_SOUND = re.compile(rf"(?:\s*[-–—,]\s*)?\b{HESITATIONS}\b(?:\s*[-–—,.…]+(?=\s|$))?", re.I)
_SOUND_SIGN = re.compile(r"\b(?:u+[hm]|e+r+m|e+r\b|h+m|m+h|m+m|a+h|e+h|o+h|ä+h|eu+h)", re.I)
_LOOSE = re.compile(r"\s[,.;:?!]|[,;]\s*[,;]")
_FILLER = re.compile(rf",\s*{FILLERS}\s*,", re.I)
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_CUE = re.compile(rf"^\s*({_CLOCK})\s*-->\s*({_CLOCK})")
_VOICE = re.compile(r"^<v\s+([^>]+)>(.*)$", re.S)
_LEGEND = re.compile(r"(speaker\s*\d+)\s*=\s*([^;\n]+?)(?=\s*(?:[;,]\s*speaker\s*\d+\s*=|;|$))", re.I | re.M)
_LEAD = re.compile(rf"^\s*[\[(]({_CLOCK})[\])]\s*(.*)$")
_AFTER = re.compile(rf"^(\S[^(\n]*?)\s+\(({_CLOCK})\):\s*(.*)$|^(\S.*?)(?<!\s)\s++\(({_CLOCK})\):\s*(.*)$")
_HEAD = re.compile(rf"^(\S.*?)(?<!\s)\s{{2,}}+({_CLOCK})\s*$")
_PLAIN = re.compile(r"^(?:>>\s*)?([^:\n]++):\s+(.*)$|^(?:>>\s*)?([^:\n]++):\s*$")
_DASH = re.compile(r"^(.+?)\s[-–—]\s(.*)$")
#: start, end, label, text
Segment = tuple[float | None, float | None, str | None, str]


def seconds(clock: str) -> float:
    parts = [float(x.replace(",", ".")) for x in clock.split(":")]
    return sum(x * 60**k for k, x in enumerate(reversed(parts)))


def clean(text: str) -> str:
    """The words of a segment without sound notes, hesitations and fillers."""
    if _NOTE_SIGN.search(text):
        text = _NOTE.sub(" ", text)
    text = _FILLER.sub(",", text)
    if _SOUND_SIGN.search(text):
        text = _SOUND.sub(" ", text)
    text = " ".join(text.split())
    if _LOOSE.search(text):
        text = re.sub(r"([,;])(?:\s*[,;])+", r"\1", re.sub(r"\s+([,.;:?!])", r"\1", text))
    text = text.strip(" ,;-–—")
    return text if re.search(r"[^\W_]", text) else ""


class Labels:
    """Which person of the meeting a label means; None if it means nobody."""

    def __init__(self, people: list[tuple[int, str | None, str | None]], legend: dict[str, str]):
        self.people = [(i, *parse_name(name)) for i, name in dict.fromkeys((i, name) for i, name, _ in people)]
        self.names: dict[int, set[str]] = {}
        for i, name, _ in people:
            self.names.setdefault(i, set()).update(fold(w) for w in re.findall(r"[^\W\d_]+(?:[-'][^\W\d_]+)*", name if isinstance(name, str) else ""))
        self.roles: dict[str, list[int]] = {}
        for i, _, role in people:
            if isinstance(role, str) and role.strip() and i not in self.roles.setdefault(self.form(role), []):
                self.roles[self.form(role)].append(i)
        self.legend, self.known = {self.form(k): v for k, v in legend.items()}, {}

    @staticmethod
    def form(label: str) -> str:
        return re.sub(r"[\s_-]+", " ", fold(label)).strip(" .:>")

    def __call__(self, label: str | None) -> int | None:
        if not label:
            return None
        if label not in self.known:
            self.known[label] = self.find(label)
        return self.known[label]

    def find(self, label: str) -> int | None:
        form = self.form(label)
        if form in self.legend and self.form(self.legend[form]) != form:
            return self.find(self.legend[form])
        bare = re.sub(r"\s*[\(\[][^()\[\]]*[\)\]]\s*$", "", label).strip()
        if bare and bare != label:
            return self.find(bare)
        if form in self.roles:
            return self.roles[form][0] if len(self.roles[form]) == 1 else None
        words = re.findall(r"[^\W\d_]+(?:[-'][^\W\d_]+)*", label)
        if not words:
            return None
        if len(words) > 5:  # a long label must be made of a name of its own, else it is speech before a colon
            said = {fold(w) for w in words}
            fits = [i for i, _, f, s in self.people if len(f) > 1 and len(s) > 1 and {f, s} <= said and len(said & self.names[i]) * 2 >= len(said)]
            return fits[0] if len(fits) == 1 else None
        if len(words) == 1 or all(len(w) == 1 for w in words):
            return self.short(fold("".join(words)), label)
        _, first, last = parse_name(label)
        best = sorted(((name_score(o, f, s, False, first, last), i) for i, o, f, s in self.people if s and f), reverse=True)
        best = [x for x in best if x[0] >= 0.5]
        return best[0][1] if best and (len(best) == 1 or best[0][0] > best[1][0]) else None

    def short(self, word: str, label: str) -> int | None:
        only = lambda found: found[0] if len(found) == 1 else None
        nick = {word, *NICKNAMES.get(word, "").split()}
        if (i := only([i for i, _, f, _ in self.people if f in nick or word in NICKNAMES.get(f, "").split()])) is not None:
            return i
        if (i := only([i for i, _, _, s in self.people if s == word])) is not None:
            return i
        letters = re.sub(r"[^a-z]", "", word)
        if 2 <= len(letters) <= 4 and label.upper() == label:
            initials = lambda f, s: f[:1] + "".join(p[:1] for p in s.split("-"))
            for fits in (lambda f, s: letters == initials(f, s), lambda f, s: letters == f[:1] + s[:1], lambda f, s: (letters[0], letters[-1]) == (f[:1], s[:1])):
                if (i := only([i for i, _, f, s in self.people if f and s and fits(f, s)])) is not None:
                    return i
        scored = sorted(((name_score(o, f, s, False, word, ""), i) for i, o, f, s in self.people if f and len(word) > 3), reverse=True)
        if scored and scored[0][0] > 0.4 and (len(scored) == 1 or scored[0][0] > scored[1][0]):
            return scored[0][1]
        glued = parse_name(label)
        if glued[1] and glued[2]:
            best = sorted(((name_score(o, f, s, *glued), i) for i, o, f, s in self.people if f and s), reverse=True)
            if best and best[0][0] >= 0.5:
                return best[0][1]
        return None


def _captions(lines: list[str], who: Callable[[str | None], int | None]) -> list[Segment]:
    out: list[Segment] = []
    at, end, body = None, None, []

    def close() -> None:
        if at is not None:
            text = "\n".join(body).strip()
            voice = _VOICE.match(text)
            if voice:
                out.append((at, end, voice[1].strip(), voice[2].replace("</v>", "")))
            else:
                m = _PLAIN.match(text.partition("\n")[0])
                label = m and (m[1] or m[3])
                if label and who(label) is not None:
                    out.append((at, end, label, text[m.end(1 if m[1] else 3) + 1 :]))
                else:
                    out.append((at, end, None, text))

    for line in lines:
        cue = _CUE.match(line)
        if cue:
            if body and body[-1].strip().isdigit():
                body.pop()
            close()
            at, end, body = seconds(cue[1]), seconds(cue[2]), []
        elif at is not None:
            body.append(line)
    close()
    return out


def _json_lines(lines: list[str]) -> list[Segment]:
    out: list[Segment] = []
    for line in lines:
        try:
            x = json.loads(line)
        except ValueError:
            continue
        if isinstance(x, dict):
            start, end = [float(v) if isinstance(v, (int, float)) else None for v in (x.get("start"), x.get("end"))]
            label = x.get("speaker")
            out.append((start, end, label if label is None else str(label), str(x.get("text") or "")))
    return out


def _labelled(lines: list[str], start: Callable[[str], Segment | None]) -> list[Segment]:
    """Segments of lines: ``start`` reads a line that opens one; all others go on with the one before."""
    out: list[Segment] = []
    for line in lines:
        new = start(line)
        if new:
            out.append(new)
        elif out and line.strip():
            at, end, label, text = out[-1]
            out[-1] = (at, end, label, f"{text}\n{line.strip()}")
    return out


def segments(text: str, who: Labels) -> list[Segment]:
    """The segments of a transcript in any known layout; without a known label there is none."""
    lines = re.split(r"\r\n|\n|\r", text)
    full = [x for x in lines if x.strip()]
    if "-->" in text and any(_CUE.match(x) for x in full):
        return _captions(lines, who)
    if sum(x.lstrip().startswith("{") for x in full) * 2 > len(full):
        return _json_lines(full)

    # a plain look at the line spares most of them the pattern
    def lead(line: str) -> Segment | None:
        m = _LEAD.match(line) if line.lstrip()[:1] in ("[", "(") else None
        if not m:
            return None
        p = _PLAIN.match(m[2])
        label = p and (p[1] or p[3])
        if label and who(label) is not None:
            return seconds(m[1]), None, label, p[2] or ""
        d = _DASH.match(m[2])
        if d and who(d[1]) is not None:
            return seconds(m[1]), None, d[1], d[2]
        return seconds(m[1]), None, None, m[2]

    def after(line: str) -> Segment | None:
        m = _AFTER.match(line) if "):" in line else None
        return (seconds(m[2] or m[5]), None, m[1] or m[4], m[3] if m[2] else m[6]) if m else None

    def head(line: str) -> Segment | None:
        m = _HEAD.match(line) if line.rstrip()[-1:].isdigit() else None
        return (seconds(m[2]), None, m[1], "") if m else None

    def plain(line: str) -> Segment | None:
        m = _PLAIN.match(line) if ":" in line else None
        label = m and (m[1] or m[3])
        return (None, None, label, m[2] or "") if label and who(label) is not None else None

    def dash(line: str) -> Segment | None:
        m = _DASH.match(line) if any(sign in line for sign in "-–—") else None
        return (None, None, m[1], m[2]) if m and who(m[1]) is not None else None

    def clocked(line: str) -> Segment | None:
        return after(line) or lead(line) or head(line)

    # the layout under which most segments have a speaker; of equal ones the first
    spoken = lambda found: sum(s[2] is not None and who(s[2]) is not None for s in found)
    return max((_labelled(lines, s) for s in (clocked, plain, dash)), key=spoken)


def overlap(a: str, b: str) -> int:
    """Length of the longest suffix of a that is a prefix of b, at a word's end (Knuth-Morris-Pratt)."""
    a = a[-len(b) :] if b else ""
    if a.rfind(b[: min(4, len(b))]) < 0 and not any(b.startswith(a[-k:]) for k in range(1, min(4, len(a) + 1))):
        return 0
    s = f"{b}\0{a}"
    fail = [0] * len(s)
    for i in range(1, len(s)):
        k = fail[i - 1]
        while k and s[i] != s[k]:
            k = fail[k - 1]
        fail[i] = k + (s[i] == s[k])
    k = fail[-1] if s else 0
    while k and not (k == len(b) or not b[k].isalnum()):
        k = fail[k - 1]
    return k


def _tail(parts: list[str], size: int) -> str:
    """At least the last ``size`` characters of the joined parts, if there are as many."""
    tail = ""
    for part in reversed(parts):
        tail = f"{part} {tail}" if tail else part
        if len(tail) >= size:
            break
    return tail


def silences(found: list[Segment]) -> tuple[list[float], float]:
    """Before each segment (in order of the clock) the time since the last end so far, and from where on it is long.

    Long is eight times the median time from start to start. Without clocks there is no silence.
    """
    gaps = [(b[0] - a[0], len(a[3])) for a, b in zip(found, found[1:], strict=False) if a[0] is not None and b[0] is not None]
    middle = lambda x: sorted(x)[len(x) // 2] if x else 0.0
    pace, long = middle([g / max(1, n) for g, n in gaps]), 8 * middle([g for g, _ in gaps])
    out, reach = [], None
    for start, end, _, text in found:
        out.append(0.0 if start is None or reach is None else start - reach)
        if start is not None:
            done = end if end is not None and end >= start else start + pace * len(text)
            reach = done if reach is None else max(reach, done)
    return out, long if gaps else float("inf")


def turns(text: str, people: list[tuple[int, str | None, str | None]], pauses: bool = False) -> list[tuple[int, float | None, str]]:
    """(person, start, clean text) of the turns of one transcript.

    A segment of nobody known without words is passed over; with words it ends the turn before it, unless it has no
    label at all. ``pauses``: a silence (see ``silences``) that is long for the meeting also ends a turn.
    """
    who = Labels(people, {k: v for k, v in _LEGEND.findall(text)} if "=" in text else {})
    found = segments(text, who)
    if found and all(s[0] is not None for s in found):
        found.sort(key=lambda s: s[0])
    quiet, long = silences(found) if pauses else ([0.0] * len(found), float("inf"))
    out: list[tuple[int, float | None, list[str]]] = []
    last, paused = None, False
    for (at, _, label, raw), silence in zip(found, quiet, strict=True):
        paused |= silence > long
        words = clean(raw)
        if not words:
            continue
        person = who(label)
        if person is None:
            if label:
                last = None
            continue
        if person == last and not paused:
            k = overlap(_tail(out[-1][2], len(words)).lower(), words.lower())
            rest = words[k:].strip() if k > 3 else words
            if rest:
                out[-1][2].append(rest)
        else:
            out.append((person, at, [words]))
        last, paused = person, False
    return [(p, start, " ".join(parts)) for p, start, parts in out]


def _run(pauses: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for meeting, text, people in zip(pdf["meeting_id"], pdf["transcript"], pdf["people"], strict=True):
                listed = sorted([(int(p["person_id"]), p["name"], p["role"]) for p in people], key=lambda p: p[0])
                rows += [(meeting, n, p, at, t) for n, (p, at, t) in enumerate(turns(text, listed, pauses), 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TURNS.split(", ")])

    return run


def speaker_turns(meetings: DataFrame, meeting_people: DataFrame, people: DataFrame, pauses: bool = False) -> DataFrame:
    """One row per clean turn: see ``TURNS``.

    Meetings without a transcript, without speakers or without listed people give no rows; a person listed twice counts
    once, with all roles; a role that two people have names neither; listed people without a people row have no name and
    can be meant by their role only.
    """
    listed = (
        meeting_people.where("meeting_id IS NOT NULL AND person_id IS NOT NULL")
        .select(F.col("meeting_id").cast("long").alias("meeting_id"), F.col("person_id").cast("long").alias("person_id"), F.col("role").cast("string").alias("role")).distinct()
        .join(people.select(F.col("id").cast("long").alias("person_id"), F.col("name").cast("string").alias("name")), "person_id", "left")
        .groupBy("meeting_id").agg(F.collect_list(F.struct("person_id", "name", "role")).alias("people"))
    )
    spoken = meetings.where("id IS NOT NULL AND trim(transcript) <> ''").select(F.col("id").cast("long").alias("meeting_id"), F.col("transcript").cast("string").alias("transcript"))
    # a number of its own keeps the tasks apart, however few bytes the texts have: the work is in reading them
    tasks = int(meetings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spoken.repartition(tasks, "meeting_id").join(listed, "meeting_id").mapInPandas(_run(pauses), TURNS)
