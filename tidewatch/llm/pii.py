"""Personal data: fixed base patterns and a linear-chain CRF beside them.

Tokens are words between white space. The CRF labels tokens with B-/I- tags
of the kinds below, from features of a token's shape and its neighbours.
Tokens with a digit, ``@`` or a written-out ``dot``/``(at)`` are wanted; they
and the ``NEAR`` plain tokens before and after each carry trained scores, all
others are held to O. So the chain falls apart into runs, cut only between
tokens held to O, each decoded whole (NumPy batches by run length) with the
same result as decoding the whole text.

The model is trained from ``LABELLED``, a small table of invented lines, or
from a table given by the caller; its weights (8,192 x 13 numbers) go to the
tasks.

Defined results: a null text is empty and has no span; null and repeated
doc_ids keep their own rows; an empty table gives an empty result; other
columns are ignored. Spans are code points, end exclusive. Base spans always
stay; a CRF span that overlaps a base span is dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewatch.llm.crf import Crf, bucket, train

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("account", "national_id")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in ("B", "I")]
BUCKETS = 1 << 13

#: Labelled lines: [kind words] marks a span of whole words. Invented data.
LABELLED = """
then [email l.moreau@mail.example] there
and [email user7@example.com] of the [card 4539578763621486] in
the [ip 203.0.113.77] of
de [ip 198.51.100.4] la
is [card 4111111111111111] for
und [card 5500005555555559] die
[card 4532015112830366] [card 6011000990139424] both
[email b.k@firma.example] [ip 192.0.2.9] [phone +49 30 5550 1234]
and [email t.berg@site.example] said
[email office@town.example.net] writes
of [ip 192.0.2.200] by
to [ip 203.0.113.5] from
from [ip 198.51.100.99] the
the [card 4111 1111 1111 1111] of
call [phone +33 1 55 50 12 34] or
call [phone +34 915 550 123] now
by [phone +1 555 010 9988] the
phone [phone 555-010-1212] or
tel [phone 040 5550199] bitte
account [account GB82 WEST 1234 5698 7654 32] open
iban [account DE12500105170648489890] bank
ssn [national_id 123-45-6789] on
passport [national_id X12Y34567] seen
passport [national_id K99L00M11] lost
the 6011000990139420 of
the 192.168.300.1 of
serial 378282246310006 found
in 2019 we had 14 and 15
at 09:15 or 10:45
the 3.5 and 4.25 of 7
room 12 of house 9
page 77 of 300
the 4539578763621481 of
de 4111111111111112 la
and 5500005555555551 is
is 1234567890123456 for
1111222233334444 5555666677778880 more
serial 4000 0566 5566 5550 found
the 300.113.2.77 of
and 10.999.1.4 in
the 256.1.1.1 und
write to [email anna.lind@post.example] before noon
Mail: [email k_9@x-y.example.org], thanks
contact [email <joe+list@site.example>] or call
e-mail [email maria@firma.example.de]; fax
reach me at [email sam(at)home@corp.example]
@home and @work are tags
see @daily for 3 tips
the host [ip 10.20.30.40] answered
from [ip 192.168.7.1] port open
server ip [ip 172.16.254.3] down
version 1.2.3 of 4.5.6.7.8 came
release 10.4.2 is out
section 3.1.4.2.7 says so
card [card 4000 0566 5566 5556] expires 04/29
paid with [card 5555-5555-5555-4444] today
visa [card 5105105105105100,] thanks
card number [card 3782 822463 10005]
order 100200300400 shipped
item 4711 costs 12.50
in 1998 and 2004 there were 12 of them
at 10:30 on 2021-05-06 we met
the years 1990-1995 and pages 12-19
call [phone +44 20 7946 0958] now
tel [phone +1 (555) 010-7788] ext
phone: [phone (555) 010-9921]
phone [phone 555-010-4477] today
Tel. [phone 030 1234567] anrufen
ring [phone 0171/5550123] bitte
telefono [phone 91 555 01 23] por favor
telephone [phone 01 55 50 12 34] merci
fax [phone 020 7946 0123] ok
mobile [phone 07700 900123] ok
account [account DE89 3704 0044 0532 0130 00] bank
IBAN [account GB29NWBK60161331926819] is mine
iban: [account FR14 2004 1010 0505 0001 3M02 606] ok
ssn [national_id 078-05-1120] on file
SSN: [national_id 219-09-9999] given
passport [national_id C01X00T47] issued
it took 3 hours and 20 minutes
about 1,000,000 people in 42 towns
id 9f86d081884c7d659a2feaa0c55ad015 in log
key = 7c1d0be9a45f38e2609b8d71f3c5a2e84d9067bf here
commit 3a5c931 and 8014e62 follow
chapter 4 verse 16
50% of 300 users
room 101 floor 7
born 1975 died 2010
$$$ 12 ### 34 *** 56
ratio 3/4 or 0.75
temperature -12 to +30 degrees
phone has 2 cameras and 64 GB
card game for 4 players aged 12
call 3 friends in 5 days
ip over 2 links
mail came 2 times
9876543210123 units sold
abc123 x9 q7z
http://site.example/p/123?id=4
pay to [account GB29 NWBK 6016 1331 9268 19] by Friday
the account [account NL91 ABNA 0417 1643 00] was closed
IBAN [account IE29 AIBK 9311 5212 3456 78] please
transfer from [account GB33 BUKB 2020 1555 5555 55] now
konto [account NL39 RABO 0300 0652 64] bitte
iban: [account MT84 MALT 0110 0001 2345 MTLC AST0 01S] ok
room GB12 WEST wing 1234 is open
on 12 MARCH 1998 and 14 JUNE 2001
the 24 BEST 1000 songs of 1999
flight BA82 from 1200 to 1430
write to [email anna at firma dot example] today
mail [email j.moreau at post dot example] please
reach [email sam (at) home (dot) example] or call
contact [email office at town dot org] for more
kim [email kim at corp dot net] said
connect the dot to the line
a red dot on the map
we met at noon at the dot of twelve
ein [card 5268465632122330] haus
le [card 5245957117777412] chat
una [card 5513613412524273] casa
green [card 4440242646288975] fields
wieder [card 5352056174833801] gehen
petit [card 5572492086828890] pain
some [card 4106792470822765] words
alte [card 4206797016877313] stadt
blue [card 4281718002390424] river
otra [card 4361078852611491] vez
long [card 5722008261995822] road
mit [card 5649366578720097] dem
haus 5379727611256517 ein
chat 4021581086201913 le
casa 4742315942594724 una
fields 5394983550326245 green
gehen 5241805788914865 wieder
pain 5659255173290484 petit
"""

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: a word with a digit or @ (the possessive start never backtracks)
WANTED = re.compile(r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
ANY = re.compile(r"[0-9@]")
#: a mail address with its signs written out
OBFUSCATED = re.compile(r"(?i:\bdot\b|[\[({]at[\])}])")
SPELLED = re.compile(r"(?i:[^\x20\x09-\x0D]*[\[({](?:at|dot)[\])}][^\x20\x09-\x0D]*|dot)")
#: plain words on either side of a wanted one that carry scores of their own
NEAR = 3
TRIM = ".,;:!?\"'<>[]{}|*#$%&"

#: Fixed by the contract of the base scan.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


_NOT_DIGIT = re.compile(r"[^0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_SHAPES = ((re.compile("[0-9]"), "d"), (re.compile("[A-Z]"), "X"), (re.compile("[a-z]"), "x"), (re.compile(r"[^\x00-\x7f]"), "u"))


@lru_cache(maxsize=200_000)
def word_features(word: str) -> tuple[int, ...]:
    core = word[:64].strip(TRIM)
    shape = core
    for r, c in _SHAPES:
        shape = r.sub(c, shape)
    short = re.sub(r"(.)\1+", r"\1", shape)
    digits = sum(c == "d" for c in shape)
    feats = ["bias", "shape=" + (shape if len(shape) <= 20 else short), "short=" + short, f"digits={min(digits, 20)}", f"length={min(len(word), 24)}"]
    if "@" in word:
        feats.append(f"at={core.count('.') > 0 and 0 < core.find('@') < len(core) - 3}")
    feats.append(f"dots={min(core.count('.'), 5)}")
    return tuple(bucket(f, BUCKETS) for f in feats)


@lru_cache(maxsize=100_000)
def context_feature(where: str, word: str) -> int:
    return bucket(f"{where}={word[:32].strip(TRIM + '()=').lower()}", BUCKETS)


@lru_cache(maxsize=100_000)
def _short(word: str) -> str:
    shape = word[:64].strip(TRIM)
    for r, c in _SHAPES:
        shape = r.sub(c, shape)
    return shape if len(shape) <= 4 else re.sub(r"(.)\1+", r"\1", shape)


@lru_cache(maxsize=100_000)
def _kind(word: str) -> str:
    core = word.strip(TRIM + "()").lower()
    if core in ("at", "dot"):
        return core
    if "@" in word:
        return "mail"
    return "number" if ANY.search(word) else "upper" if word.isupper() else "plain" if word else ""


_IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]*")
_IBAN_PART = re.compile(r"[A-Z0-9]+")


def _iban(words: list[str], i: int) -> int:
    """Words from ``i`` on that form an account number with right check digits."""
    if not _IBAN_HEAD.fullmatch(words[i].strip(TRIM + "()")):
        return 0
    found, whole = 0, ""
    for j in range(i, min(i + 12, len(words))):
        part = words[j].strip(TRIM + "()")
        whole += part
        if not _IBAN_PART.fullmatch(part) or len(whole) > 34:
            break
        if len(whole) >= 15 and int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1:
            found = j - i + 1
        if words[j][-1] in ".,;:)":
            break
    return found


def run_features(words: list[str]) -> Iterator[list[int]]:
    """Features of a run of wanted words and the plain words around them."""
    n = len(words)
    start = end = iban_end = 0
    whole = ""
    for i, w in enumerate(words):
        if i >= iban_end and (got := _iban(words, i)):
            iban_start, iban_end = i, i + got
        iban = "" if i >= iban_end else "first" if i == iban_start else "inside"
        prev = words[i - 1] if i else ""
        nxt = words[i + 1] if i + 1 < n else ""
        f = list(word_features(w))
        f.append(bucket(f"iban={iban}", BUCKETS))
        if not ANY.search(w):
            f.append(bucket("plain", BUCKETS))
            f.append(context_feature("word", w))
            f.append(bucket(f"kinds={_kind(prev)}/{_kind(w)}/{_kind(nxt)}", BUCKETS))
            if w.isupper():
                f.append(bucket(f"shapes={_short(prev)}/{_short(w)}/{_short(nxt)}", BUCKETS))
            near = [_kind(x) for x in words[max(0, i - 3) : i + 4]]
            at = i - max(0, i - 3)
            spelled = [f"{k}{j - at}" for j, k in enumerate(near) if k in ("at", "dot")]
            f.append(bucket(f"spelled={' '.join(spelled)}", BUCKETS))
            f.append(bucket(f"written={'at' in near and 'dot' in near}", BUCKETS))
            yield f
            continue
        if i >= end:  # a new block of wanted words
            start = end = i
            while end < n and ANY.search(words[end]):
                end += 1
            whole = _valid("".join(words[start:end])) if end - start > 1 else ""
        before = words[start - 1] if start else ""
        f.append(context_feature("before", before))
        if before.isupper():  # a bank code
            f.append(bucket(f"beforeshape={_short(before)}/{_size(words[start - 2]) if start > 1 else ''}", BUCKETS))
        f.append(bucket(f"valid={_valid(w)}", BUCKETS))
        f.append(bucket(f"whole={whole}", BUCKETS))
        f.append(bucket(f"place={min(i - start, 3)}/{min(end - start, 6)}", BUCKETS))
        f.append(bucket(f"prev={_size(prev) if i > start else ''}", BUCKETS))
        f.append(bucket(f"next={_size(nxt) if i + 1 < end else ''}", BUCKETS))
        f.append(context_feature("after", nxt) if i + 1 == end else bucket("inside", BUCKETS))
        yield f


def _valid(word: str) -> str:
    """Check digit of a number of card length, octets of a dotted quad, form of an address."""
    if "@" in word:
        return f"mail {EMAIL.search(word) is not None}"
    digits = _NOT_DIGIT.sub("", word)
    if "." in word and re.fullmatch(r"[0-9]{1,6}(\.[0-9]{1,6}){3}", word.strip(TRIM)):
        return f"octets {all(int(x) <= 255 for x in word.strip(TRIM).split('.'))}"
    return f"luhn {luhn(digits)}" if 13 <= len(digits) <= 19 else ""


def _size(word: str) -> str:
    return "" if not word else f"{word[0] == '+'}{min(sum(c.isdigit() for c in word), 9)}"


def _moves() -> np.ndarray:
    k = len(LABELS)
    ok = np.ones((k + 1, k), dtype=bool)
    for j, name in enumerate(LABELS):
        if name.startswith("I-"):
            ok[:, j] = [i < k and LABELS[i][2:] == name[2:] for i in range(k + 1)]
    return ok


def _wanted(text: str) -> Iterator[tuple[int, int]]:
    if not OBFUSCATED.search(text):
        return (m.span() for m in WANTED.finditer(text))
    return (m.span() for m in WORD.finditer(text) if ANY.search(m[0]) or SPELLED.fullmatch(m[0].strip(TRIM)) or SPELLED.fullmatch(m[0]))


def _last_words(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The last ``NEAR`` words between two places."""
    size = 64
    while True:
        low = max(start, end - size)
        words = [m.span() for m in WORD.finditer(text, low, end)]
        if low == start:
            return words[-NEAR:]
        if len(words) > NEAR:  # the first may be cut
            return words[-NEAR:]
        size *= 4


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of wanted words with the ``NEAR`` plain words before and after each."""
    run: list[tuple[int, int]] = []
    last = 0
    for a, b in _wanted(text):
        if run:
            gap = [m.span() for m in islice(WORD.finditer(text, last, a), 2 * NEAR + 1)]
            if len(gap) <= 2 * NEAR:
                run += gap
            else:
                yield run + gap[:NEAR]
                run = _last_words(text, gap[NEAR - 1][1], a)
        else:
            run = _last_words(text, 0, a)
        run.append((a, b))
        last = b
    if run:
        yield run + [m.span() for m in islice(WORD.finditer(text, last), NEAR)]


def parse_labelled(lines: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Marked lines -> (text, spans)."""
    out = []
    for line in filter(None, map(str.strip, lines.split("\n"))):
        text, spans, pos = "", [], 0
        for m in re.finditer(r"\[(%s) ([^\]]+)\]" % "|".join(KINDS), line):
            text += line[pos : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            pos = m.end()
        out.append((text + line[pos:], spans))
    return out


def train_model(labelled: list[tuple[str, list[tuple[str, int, int]]]]) -> Crf:
    data = []
    for text, spans in labelled:
        for run in _runs(text):
            labels = []
            for a, b in run:
                own = next(((k, s) for k, s, e in spans if s <= a < e), None)
                labels.append("O" if own is None else ("B-" if not any(own[1] <= x < a for x, _ in run) else "I-") + own[0])
            data.append((list(run_features([text[a:b] for a, b in run])), labels))
    # features are hashed already: train on their numbers
    model = train([([[str(f) for f in t] for t in toks], ys) for toks, ys in data], LABELS, _moves(), BUCKETS)
    emit = np.zeros_like(model.emit)
    for f in {f for toks, _ in data for t in toks for f in t}:
        emit[f] = model.emit[bucket(str(f), BUCKETS)]
    model.emit = emit
    return model


def crf_spans(texts: list[str], model: Crf) -> list[list[tuple[int, int, int]]]:
    """CRF spans of each text, decoded together."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    by_length: dict[int, list[tuple[int, list[tuple[int, int]], np.ndarray]]] = {}
    for i, text in enumerate(texts):
        if not ANY.search(text) and not OBFUSCATED.search(text):
            continue
        for run in _runs(text):
            # scores are kept, not features: a run may be as long as its text
            feats = run_features([text[a:b] for a, b in run])
            parts = []
            while part := list(islice(feats, 4096)):
                parts.append(model.scores(part))
            by_length.setdefault(len(run), []).append((i, run, np.concatenate(parts)))
    for length, every in by_length.items():
        for at in range(0, len(every), 4096):
            group = every[at : at + 4096]
            paths = model.viterbi(np.stack([scores for _, _, scores in group]))
            for (i, run, _), path in zip(group, paths, strict=True):
                out[i] += _spans_of(texts[i], run, path)
    return out


def _spans_of(text: str, run: list[tuple[int, int]], path: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of a run's labels."""
    out = []
    length, t = len(run), 0
    while t < length:
        name = LABELS[path[t]]
        if name == "O":
            t += 1
            continue
        end = t + 1
        while end < length and LABELS[path[end]] == "I-" + name[2:]:
            end += 1
        raw = text[run[t][0] : run[end - 1][1]]
        a = run[t][0] + len(raw) - len(raw.lstrip(TRIM))
        b = a + len(raw.strip(TRIM))
        if b > a:
            out.append((KINDS.index(name[2:]), a, b))
        t = end
    return out


def find_personal(docs: DataFrame, model: Crf | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, base counts and digest, ``spans`` text (all spans by kind, then
    start) and, with ``keep_text``, the whole text."""
    model = model or train_model(parse_labelled(LABELLED))

    def digest(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"].tolist()]
            rows = []
            for base, more in zip((base_spans(t) if ANY.search(t) else [] for t in texts), crf_spans(texts, model), strict=True):
                new = [s for s in more if not any(a < s[2] and s[1] < b for _, a, b in base)]
                n = [sum(k == i for k, _, _ in base) for i in range(len(BASE_KINDS))]
                rows.append((*n, hashlib.sha256(digest(base).encode()).hexdigest(), digest(sorted(base + new))))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object) if len(pdf) else [])
            if keep_text:
                out["text"] = texts
            yield out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInPandas(work, schema + (", text string" if keep_text else ""))
