"""The grammar of transcript text: speaker heads, times, sound notes, speech; and what is left of the speech.

A text is parsed on a copy whose full-width ASCII is narrowed (same length, so positions hold). The tree is
turned into an ``Utterance``: speaker label, time, spoken text without heads, times, notes and hesitations.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from typing import Any, NamedTuple

from cliplake.llm.peg import Grammar, first, many, opt, seq, term

_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0x3010: 0x5B, 0x3011: 0x5D}

G = Grammar()
_ws = term(r"[\s\u200b\ufeff]*")
_clock = term(r"(?:\d{1,3}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?(?![\d:])")
stamp = G.define(
    "stamp",
    first(
        seq(term(r"\[\s*"), G.define("clock", _clock), term(r"\s*(?:-->\s*[\d:.,]+\s*)?\]")),
        seq(term(r"\(\s*"), G.ref("clock"), term(r"\s*\)")),
        seq(term(r"<\s*"), G.ref("clock"), term(r"\s*>")),
        seq(G.ref("clock"), term(r"\s*-->(?:\s*[\d:.,]+)?")),
    ),
)
bare = G.define("bare", G.ref("clock"))
#: A numbered speaker in any notation, or a name: one or two capitalised words, or a word in brackets.
numbered = term(r"(?i:\[?(?:speaker|spk|spkr|s)[\s_#\-]*\d{1,4}\]?)(?![\w])")
named = term(r"\[[^\W\d_]{2,20}\]|[A-Z]{3,20}(?![\w])|(?i:host|guest|unknown|moderator|narrator|interviewer)(?![\w])")
label = G.define("label", first(numbered, named))
_sep = term(r"\s*(?::|>|—|–|\s-\s)")
voice = seq(term(r"<v\s+"), G.define("label_v", term(r"[^<>]{1,40}")), term(r">"))
cue = seq(opt(term(r"(?:>>+|-|–|—)\s*")), G.ref("label"), opt(seq(_ws, G.ref("stamp"))), _sep)
head = G.define("head", seq(_ws, opt(seq(first(stamp, bare), _ws)), first(voice, cue)))

_inner = term(r"[^\[\](){}<>*♪]+")
note = G.define(
    "note",
    first(
        seq(term(r"\["), many(first(G.ref("note"), _inner, term(r"[(){}<>*♪]"))), term(r"\]")),
        seq(term(r"\("), many(first(G.ref("note"), _inner, term(r"[\[\]{}<>*♪]"))), term(r"\)")),
        seq(term(r"</?"), many(first(G.ref("note"), _inner, term(r"[\[\](){}*♪]"))), term(r">")),
        seq(term(r"\{"), many(first(G.ref("note"), _inner, term(r"[\[\]()<>*♪]"))), term(r"\}")),
        term(r"\*[^*\n]{1,80}\*"),
        term(r"[♪♫]+"),
    ),
    openers=r"[\[({<]",
)
speech = G.define("speech", term(r"(?:(?!\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?\s*-->)[^\[(<{*♪♫\d]|\d++(?!:\d{2}(?::\d{2})?(?:[.,]\d+)?\s*-->))+"))
segment = G.define("segment", seq(opt(head), many(first(speech, stamp, note, G.define("other", term(r"\d+(?=\d{3}:\d)|(?s:.)"))))))

#: Hesitation sounds, as shapes: any lengthening of them is the same sound.
SOUNDS = (
    r"u+h+m*", r"u+m+", r"e+r+m*", r"h+m+", r"m+h+", r"m{2,}h*", r"h+u+m+", r"e+h+m*", r"e+u+h+", r"h+e+u+",
    r"ä+h+m*", r"ö+h+m*", r"h+ã+", r"a+h+n+", r"é{2,}", r"э+м+", r"э{2,}", r"э+(?:-э+)+", r"м{2,}",
)
#: Phrases without content.
PHRASES = (r"you\s+know", r"i\s+mean", r"o\s+sea", r"tu\s+vois")
#: Sounds and phrases in scripts without spaces.
UNSPACED = (r"嗯+", r"呃+", r"唔+", r"えっと", r"あのー+", r"えーと+", r"うーん+")
_FILLER = re.compile(r"(?<![\w'’])(?=[aehimuyotäöéэм])(?:" + "|".join(SOUNDS + PHRASES) + r")(?![\w])|" + "|".join(UNSPACED), re.I)
#: Sounds that are words of some language, with frequent words of that language and of the languages of the sound.
_WORDS = {
    "um": re.compile(
        r"\b(?:não|uma|que|você|vocês|para|hoje|ontem|amanhã|muito|nossa|isso|isto|com|na|da|dos|das|de|ninguém|até|dois|duas|depois|antes|logo|bem|então|já|também|só|foi|era|ser|ter|tem|há|quando|como"
        r"|porque|por|mais|mas|se|em|ao|pelo|pela|meu|minha|seu|sua|este|esta|esse|essa|ele|ela|eu|nós|lá|aqui|noite|dia|ano|semana|gente|alguém|die|der|das|den|dem|und|ist|nicht|ein|eine|wir|ich|zu|für|mit|auf)\b",
        re.I,
    ),
    "er": re.compile(r"\b(?:die|der|das|den|dem|und|ist|nicht|ein|eine|wir|ich|für|wenn|man|zu|hat|mit|auf|dass|aber|auch)\b", re.I),
}
_ENGLISH = re.compile(
    r"\b(?:the|of|and|to|you|we|is|was|this|that|with|for|it|are|i|my|what|if|at|be|in|on|so|not|have|has|had|been|there|here|they|them|our|your|me|us|an|about|how|when|than|then|all|some|most|more|will|would|should"
    r"|could|can|from|by|but|or|do|did|does|were|one|two|out|up|too|very|just|still|never|next|last|first|let|look|take|wait|tell|please|honestly|thanks|today|tomorrow|tonight|yesterday)\b",
    re.I,
)
_HINT = re.compile(r"[\[(<{*♪♫:：（【＜>]|—|–|^\s*-")


#: Where a phrase is part of the sentence: after an auxiliary the verb must follow, and what follows it is no verb.
_AUXILIARY = re.compile(r"\b(?:do|does|did|don['’]?t|doesn['’]?t|didn['’]?t|should|would|could|can|will|must|may|might)\s+$", re.I)
_OBJECT = re.compile(
    r"\s+(?:the|a|an|this|that|these|those|it|them|him|her|me|us|my|your|his|their|our|how|what|why|who|where|when|whether|which|if|about|of|some|any|anyone|anything|someone|something)\b", re.I
)
_WHAT, _COPULA = re.compile(r"\bwhat\s+$", re.I), re.compile(r"\s+(?:is|was|by|here)\b", re.I)


def _is_filler(m: re.Match, text: str) -> bool:
    if m[0][:1] in "yYiI" and len(m[0]) > 5:
        before, after = text[max(0, m.start() - 16) : m.start()], text[m.end() : m.end() + 16]
        if m[0][:1] in "yY":
            return not (_AUXILIARY.search(before) and _OBJECT.match(after))
        return not (_WHAT.search(before) and _COPULA.match(after))
    own = _WORDS.get(m[0].lower())
    return own is None or len(own.findall(text)) < max(1, len(_ENGLISH.findall(text)))


def without_fillers(text: str) -> str:
    return _FILLER.sub(lambda m: " " if _is_filler(m, text) else m[0], text)


class Utterance(NamedTuple):
    label: str | None
    clock_ms: int | None
    spoken: str


def clock_ms(text: str) -> int | None:
    """'01:02:03.4', '02:03', '62.5' -> milliseconds."""
    try:
        total = 0.0
        for part in text.strip().replace(",", ".").split(":"):
            total = total * 60 + float(part)
        return round(total * 1000)
    except ValueError:
        return None


def _find(nodes: list, names: tuple[str, ...]):
    for n in nodes:
        if n[0] in names:
            return n
        if (r := _find(n[3], names)) is not None:
            return r
    return None


def parse(text: str) -> Utterance:
    """One segment or line of a transcript."""
    if not _HINT.search(text):
        return Utterance(None, None, without_fillers(text))
    flat = text.translate(_NARROW)
    tree = G.parse("segment", flat)
    label_text, at_ms, spoken = None, None, []
    for name, a, b, children in tree[3] if tree else ():
        if name == "head":
            n = _find(children, ("label", "label_v"))
            label_text = flat[n[1] : n[2]]
            if (c := _find(children, ("clock",))) is not None:
                at_ms = clock_ms(flat[c[1] : c[2]])
        elif name == "stamp":
            if at_ms is None and not spoken and (c := _find(children, ("clock",))) is not None:
                at_ms = clock_ms(flat[c[1] : c[2]])
            spoken.append(" ")
        elif name == "note":
            spoken.append(" ")
        else:
            spoken.append(text[a:b])
    return Utterance(label_text, at_ms, without_fillers("".join(spoken)))


_NUMBER = re.compile(r"^(?:speaker|spkr|spk|s)?[\s_#\-]*0*(\d+)$", re.I)
_UNKNOWN = {"", "UNKNOWN", "UNK", "NONE", "NULL", "N/A", "NA", "?", "??", "UNDEFINED", "UNBEKANNT"}


def speaker_name(raw: Any) -> str | None:
    """SPEAKER_nn for numbered speakers, else the bare name in capitals; None where missing or unknown."""
    if raw is None or isinstance(raw, (dict, list, bool)) or raw != raw:
        return None
    return _named(str(raw))


@lru_cache(10_000)
def _named(raw: str) -> str | None:
    name = unicodedata.normalize("NFKC", raw).strip(" \t\r\n\u200b\ufeff[](){}<>:*\"'")
    if m := _NUMBER.match(name):
        return f"SPEAKER_{int(m[1]):02d}"
    name = re.sub(r"\s+", " ", name).upper()
    return None if name in _UNKNOWN else name


def letters(text: str) -> int:
    """Letters and digits (Unicode L and N)."""
    return sum(map(str.isalnum, text))


def seconds_ms(value: Any) -> int | None:
    """A time as number of seconds or as clock text, to milliseconds."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return round(value * 1000) if abs(value) < 9e12 else None
    return clock_ms(value) if isinstance(value, str) else None


def _times(seg: dict) -> tuple[int | None, int | None]:
    if isinstance(o := seg.get("offsets"), dict):
        a, b = o.get("from"), o.get("to")
        return tuple(round(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None for x in (a, b))
    a, b = (seg.get(k, seg.get(k + "_sec")) for k in ("start", "end"))
    return seconds_ms(a), seconds_ms(b)


class Segment(NamedTuple):
    position: int
    start_ms: int | None
    end_ms: int | None
    speaker: str | None
    spoken: str
    key: Any


def stored_segments(segments_json: str | None) -> list | None:
    """The stored list of segments; None where there is none and the raw text holds."""
    if segments_json is None or not segments_json.strip():
        return None
    try:
        found = json.loads(segments_json)
    except (ValueError, RecursionError):
        return None
    found = [found] if isinstance(found, dict) else found
    return found if isinstance(found, list) and found else None


def read_segments(segments_json: str | None, text_full: str | None) -> list[Segment]:
    """The segments of a transcript as stored, or the lines of its raw text; position counts as stored."""
    stored = stored_segments(segments_json)
    out: list[Segment] = []
    if stored is not None:
        for i, s in enumerate(stored):
            s = {"text": s} if isinstance(s, str) else s
            if not isinstance(s, dict):
                continue
            text = s.get("text")
            u = parse(text) if isinstance(text, str) else Utterance(None, None, "")
            start, end = _times(s)
            key = (start, end, str(s.get("speaker")), text, s.get("confidence")) if isinstance(text, str) else json.dumps(s, sort_keys=True)
            out.append(Segment(i, start, end, speaker_name(s.get("speaker")) or speaker_name(u.label), u.spoken, key))
        return out
    for line in (text_full or "").splitlines():
        if not line.strip():
            continue
        u = parse(line)
        who = speaker_name(u.label)
        if u.label is None and out:  # it continues the line before
            before = out[-1]
            out[-1] = before._replace(spoken=f"{before.spoken} {u.spoken}", key=(before.key, line))
        else:
            out.append(Segment(len(out), u.clock_ms, None, who, u.spoken, line if u.clock_ms is not None else len(out)))
    return [s._replace(end_ms=n.start_ms) for s, n in zip(out, [*out[1:], Segment(0, None, None, None, "", 0)])]
