"""The text that the sender of an e-mail newly wrote, without quoted history, signatures and notices.

Per thread, a generalised suffix automaton over words is grown message by message; lines that are covered by long
matches with earlier messages are inherited, however they are wrapped or marked. Marks of quotation, introducing
lines and header blocks are read too, since the quoted message need not be in the table. What the sender wrote is
then freed of its ending: closing formulas, names, rules, and paragraphs that recur at the end of a sender's, or of
several senders', messages.

Every message is compared with all earlier ones of its thread, and with the one that it replies to. In a thread of
over MOST_CHARS characters no automaton holds them all: their runs of LEAST_MATCH words are hashed and joined with the
earliest message that has each, which covers the same words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.session import cut

#: Characters of a thread that one task may hold, with an automaton over its words.
MOST_CHARS = 1_500_000
#: Rows (an id and a thread each) up to which the list of mails that other threads reply to is broadcast.
MOST_BROADCAST = 200_000
#: Non-blank lines after a rule that make it the beginning of an ending by themselves.
FEW_LINES = 8
#: Words that a match needs to be inherited text, and the share of a line's words that matches must cover.
LEAST_MATCH, LEAST_COVER = 10, 0.6
WORD = re.compile(r"[^\W_]+")
_PLAIN, _DIGIT = re.compile(r"[^\W_]+(?:'[^\W_]+)?"), re.compile(r"\d")
SUBJECT_MARK = r"(?i)^\s*(?:(?:re|fw|fwd|aw|wg|antw|sv|vs|tr|rv|rif|res|ref|enc|i|r)\s*(?:\[\d+\])?\s*:\s*|\[fwd?\]\s*)+"
QUOTED = re.compile(r"^\s*(?:[>|]|[A-ZÀ-ÞČŠŽ]{2,3}>)")
PREFIX = re.compile(r"^\s*(?:(?:[>|]|[A-ZÀ-ÞČŠŽ]{2,3}>)\s?)+")
INTRO = re.compile(r"^\s*(?:On|Am|Le|El|Il|Em|Op|Den)\b.*\d.*:\s*$")
#: Names of mail headers in English, German, French and Spanish (fixed values).
HEADER = re.compile(r"^\s*\*?(?:From|Sent|Date|To|Cc|Subject|Von|Gesendet|Datum|An|Betreff|De|Envoyé|À|Objet|Enviado|Fecha|Para|Asunto)\*?\s?:\*?(?:\s|$)")
FORWARD = re.compile(r"^\s*(?:-{3,}\s*[^\W\d_][^-]*[^\W_]\s*-{3,}|_{20,}|(?:Begin forwarded message|Anfang der weitergeleiteten Nachricht|Début du message transféré|Inicio del mensaje reenviado)\s?:)\s*$")
RULE = re.compile(r"^\s*(?:--|[-_=*~#](?:\s?[-_=*~#]){2,})\s*$")
#: Closing formulas in English, German, French and Spanish, without marks (fixed values).
CLOSINGS = frozenset("""
best|best regards|best wishes|kind regards|kindest regards|warm regards|regards|many thanks|many thanks and best wishes|thanks|thanks a lot|thank you|cheers|sincerely|yours sincerely|yours faithfully|yours truly|all the best|take care
gruß|grüße|lg|vg|mfg|liebe grüße|viele grüße|beste grüße|schöne grüße|herzliche grüße|freundliche grüße|mit freundlichen grüßen|mit freundlichem gruß|mit besten grüßen|vielen dank|vielen dank und viele grüße|danke|danke und gruß|danke und viele grüße|bis bald
cordialement|bien cordialement|bien à vous|bien à toi|amicalement|sincèrement|salutations|meilleures salutations|salutations distinguées|merci|merci et bonne journée|merci d'avance|bonne journée|à bientôt
saludos|un saludo|saludos cordiales|un cordial saludo|atentamente|muchas gracias|gracias|gracias y un saludo|muchas gracias y saludos|cordialmente|un abrazo|hasta pronto
""".strip().replace("\n", "|").split("|"))


def bare_subject(subject: Column) -> Column:
    """A subject without reply and forward marks."""
    return F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), SUBJECT_MARK, ""))


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


class SuffixAutomaton:
    """A generalised suffix automaton over sequences of words."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """A copy of q for the shorter sequences that reach it from p."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            p = last
            if word in self.next[p]:
                q = self.next[p][word]
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                continue
            last = self._state(self.length[p] + 1, {}, 0)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)

    def covered(self, words: list[str], least: int) -> list[bool]:
        """For each word, whether a match of `least` words or more covers it."""
        out, state, length = [False] * len(words), 0, 0
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= least:
                for i in range(k, k - length, -1):
                    if out[i]:
                        break
                    out[i] = True
        return out


def run_hashes(thread: str, words: list[str]) -> list[int]:
    """A 63-bit hash of each run of LEAST_MATCH words, for one thread."""
    prime, base = (1 << 61) - 1, 1_000_003
    known: dict[str, int] = {}
    for w in {*words, thread}:
        known[w] = int.from_bytes(blake2b(w.encode("utf-8", "replace"), digest_size=8).digest()) % prime
    first, out, value = pow(base, LEAST_MATCH, prime), [], 0
    salt = pow(known[thread], 3, prime)
    for k, w in enumerate(words):
        value = (value * base + known[w]) % prime
        if k >= LEAST_MATCH:
            value = (value - known[words[k - LEAST_MATCH]] * first) % prime
        if k >= LEAST_MATCH - 1:
            out.append((value + salt) % prime)
    return out


class SeenRuns:
    """The hashed runs of a message that earlier messages have; stands in for the automaton of a large thread."""

    def __init__(self, thread: str, seen: set[int]):
        self.thread, self.seen = thread, seen

    def covered(self, words: list[str], least: int) -> list[bool]:
        out = [False] * len(words)
        for k, h in enumerate(run_hashes(self.thread, words)):
            if h in self.seen:
                out[k : k + least] = [True] * least
        return out


def _words(lines: list[str]) -> list[str]:
    return [w for x in lines for w in WORD.findall(PREFIX.sub("", x).lower())]


def _lines(body: str | None) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in (body or "").split("\n")]


def own_lines(lines: list[str], automaton: SuffixAutomaton | SeenRuns | None) -> list[bool]:
    """For each line, whether it is neither quoted nor forwarded nor introduces such lines."""
    n = len(lines)
    own = [not QUOTED.match(x) for x in lines]
    words = [WORD.findall(PREFIX.sub("", x).lower()) for x in lines]
    inherited = [False] * n
    if automaton is not None:
        seen = automaton.covered([w for ws in words for w in ws], LEAST_MATCH)
        at = 0
        for k, ws in enumerate(words):
            inherited[k] = bool(ws) and sum(seen[at : at + len(ws)]) >= LEAST_COVER * len(ws)
            at += len(ws)
    for k in range(1, n - 1):  # a line of running text that happens to begin with a sign
        alone = not own[k] and own[k - 1] and own[k + 1] and not inherited[k]
        if alone and lines[k - 1].strip() and not lines[k - 1].rstrip().endswith((".", ":", "!", "?")) and re.match(r"\s*[>|] \S", lines[k]):
            own[k] = True
    unmarked = set()  # first lines of quoted messages that no mark sets off
    for k in range(n):
        if not own[k]:
            continue
        joined = f"{lines[k]} {lines[k + 1].strip()}" if k + 1 < n else ""
        for text, size in ((lines[k], 1), (joined, 2)):
            if INTRO.match(text) and (size == 1 or not lines[k].rstrip().endswith((".", "!", "?"))):
                follow = next((i for i in range(k + size, n) if lines[i].strip()), n)
                if follow == n or QUOTED.match(lines[follow]) or inherited[follow] or re.search(r"\d{1,2}[:.]\d\d", text):
                    own[k : k + size] = [False] * size
                    if follow < n and own[follow] and not QUOTED.match(lines[follow]):
                        unmarked.add(follow)
                break
    k = 0
    while k < n:
        head = k + 1 if FORWARD.match(lines[k]) else k
        while head < n and head > k and not lines[head].strip():
            head += 1
        end = head
        while end < n and HEADER.match(lines[end]):
            end += 1
        if k in unmarked or own[k] and (end - head >= 3 or end - head >= 1 and head > k):
            # an unmarked message follows: up to its last inherited line if it is known, else up to the end
            last = max((i for i in range(end, n) if inherited[i]), default=n - 1)
            for i in range(k, last + 1):
                own[i] = False
            k = last + 1
        else:
            k += 1
    return [o and not i for o, i in zip(own, inherited)]


#: What `written` must know of a line, as bits.
OWN, FILLED, CLOSING, NAME, RULED, STOPPED = 1, 2, 4, 8, 16, 32


def facts(lines: list[str], own: list[bool], sender: str | None) -> bytes:
    """A byte of the bits above for each line."""
    names = _names(sender)
    out = bytearray(len(lines))
    for k, x in enumerate(lines):
        if not own[k]:
            continue
        stripped = x.strip()
        if not stripped:
            out[k] = OWN
            continue
        end = stripped[-1]
        words = " ".join(_PLAIN.findall(x.lower())) if len(stripped) <= 60 else ""
        out[k] = OWN | FILLED | (CLOSING if words in CLOSINGS and end not in ".?" else 0) | (NAME if _is_name(x, names) else 0) | (RULED if RULE.match(x) else 0) | (STOPPED if end in ".!?,:;-–—" else 0)
    return bytes(out)


def _paragraphs(flags: bytes, low: int, high: int) -> list[list[int]]:
    """Runs of own non-blank lines between two lines, as line numbers; a rule is a run of its own."""
    out: list[list[int]] = []
    for k in range(low, high):
        if flags[k] & (OWN | FILLED) != OWN | FILLED:
            continue
        if out and out[-1][-1] == k - 1 and not (flags[k] | flags[k - 1]) & RULED:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def _key(lines: list[str]) -> int | None:
    """A 63-bit value of the words of some lines, digits alike; None without words."""
    words = " ".join(WORD.findall(_DIGIT.sub("0", " ".join(lines)).lower()))
    return xxhash.xxh3_64_intdigest(words) >> 1 if words else None


def _tail(lines: list[str], flags: bytes) -> list[tuple[int, int]]:
    """First line and key of what may belong to an ending: paragraphs, and unclosed last lines of runs."""
    n = len(lines)
    out = {p[0]: _key([lines[k] for k in p]) for p in _paragraphs(flags, 0, n)}
    for k, x in enumerate(lines):
        if k not in out and flags[k] & OWN and (k + 1 == n or not flags[k + 1] & OWN or not flags[k + 1] & FILLED) and not x.rstrip().endswith((".", ",", ":", "!", "?", ";")) and len(WORD.findall(x)) >= 3:
            out[k] = _key([x])
    return sorted((k, v) for k, v in out.items() if v is not None)


def _names(sender: str | None) -> set[str]:
    return set(WORD.findall(_fold((sender or "").split("@")[0].replace("<", " "))))


def _is_name(line: str, names: set[str]) -> bool:
    if not names or len(line) > 100 or line.count(" ") > 12:
        return False
    words = WORD.findall(_fold(line))
    return 0 < len(words) <= 4 and all(w in names for w in words)


def written(flags: bytes, recurring: set[int]) -> list[int]:
    """Numbers (from 1) of the non-blank own lines before the ending of each run of own lines.

    flags are the facts of a mail's lines, recurring the first lines of paragraphs that recur at ends of mails. An ending
    begins with a closing formula, a name, or a rule before a few lines, names or what recurs; paragraphs that recur
    are taken off the end as long as there are any.
    """
    out, k, n = [], 0, len(flags)
    while k < n:
        if not flags[k] & OWN:
            k += 1
            continue
        end = k
        while end < n and flags[end] & OWN:
            end += 1
        stop = end
        for i in range(k, end):
            if not flags[i] & (CLOSING | NAME | RULED):
                continue
            after = [j for j in range(i + 1, end) if flags[j] & FILLED]
            rule = flags[i] & RULED and (len(after) <= FEW_LINES or i + 1 in recurring or any(flags[j] & NAME for j in after))
            if flags[i] & CLOSING or flags[i] & NAME and i > k or rule:
                stop = i
                break
        paragraphs = _paragraphs(flags, k, stop)
        while paragraphs and ((paragraphs[-1][0] in recurring and (len(paragraphs) > 1 or out)) or paragraphs[-1][-1] in recurring and not flags[paragraphs[-1][-1]] & STOPPED):
            stop = paragraphs[-1].pop(0 if paragraphs[-1][0] in recurring else -1)
            paragraphs = [p for p in paragraphs if p and p[0] < stop]
        out += [i + 1 for i in range(k, stop) if flags[i] & FILLED]
        k = end
    return out


_OUT = "email_id bigint, thread string, message string, at double, target boolean, sender string, first boolean, flags binary, starts array<int>, keys array<bigint>, body string"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.bool_(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()]


def _analysed(lines: list[str], automaton: SuffixAutomaton | SeenRuns | None, sender: str | None) -> tuple[bytes, list[int], list[int]]:
    flags = facts(lines, own_lines(lines, automaton), sender)
    tail = _tail(lines, flags)
    return flags, [k for k, _ in tail], [v for _, v in tail]


def _thread(rows: list[tuple]) -> Iterator[tuple]:
    """Facts of the target messages of one thread; rows (email_id, thread, message, at, target, sender, body) by email_id."""
    at, filled = 0.0, []
    for r in rows:
        at = at if r[3] is None else r[3]
        filled.append((at, r))
    filled.sort(key=lambda x: (x[0], x[1][0]))
    messages = len({r[2] for _, r in filled})
    automaton = SuffixAutomaton() if messages > 1 else None
    done: dict[str, tuple] = {}
    for at, (i, thread, message, _, target, sender, body) in filled:
        first = message not in done
        if first:
            lines = _lines(body)
            done[message] = _analysed(lines, automaton, sender)
            if len(done) < messages:
                automaton.add(_words(lines))
        if target:
            yield i, None, None, at, True, sender, first, *done[message], None


def _threads(rows: DataFrame) -> DataFrame:
    """Facts of all target messages, thread by thread; the rows of threads of over MOST_CHARS characters as they are."""

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    def as_is(r: tuple) -> tuple:
        return (*r[:6], None, None, None, None, r[6])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chars, out = None, [], 0, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[1] != now:
                    out += _thread(held)
                    now, held, chars = r[1], [], 0
                chars += len(r[6])
                held.append(r)
                if chars > MOST_CHARS:
                    out += map(as_is, held)
                    held = []
                if len(out) >= 5000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out + list(_thread(held)))

    return rows.select("email_id", "thread", "message", "at", "target", "sender", "body").repartition("thread").sortWithinPartitions("thread", "email_id").mapInArrow(run, _OUT)


def _large(rows: DataFrame) -> DataFrame:
    """As _threads, for threads of any size."""
    filled = F.coalesce(F.last("at", ignorenulls=True).over(Window.partitionBy("thread").orderBy("email_id")), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("thread", "message").orderBy("at", "email_id"))
    light = rows.select("thread", "message", "email_id", "at", "target", "sender").withColumn("at", filled).withColumn("place", place)
    light = cut(light)
    firsts = light.where("place = 1").select("thread", "message", "email_id", "at").join(rows.select("thread", "message", "email_id", "sender", "body").distinct(), ["thread", "message", "email_id"])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(h, t, m, i, a) for t, m, i, a, b in zip(batch["thread"], batch["message"], batch["email_id"], batch["at"], batch["body"]) for h in set(run_hashes(t, _words(_lines(b))))]
            yield pd.DataFrame(out, columns=["run", "thread", "message", "email_id", "at"])

    found = firsts.select("thread", "message", "email_id", "at", "body").mapInPandas(runs, "run bigint, thread string, message string, email_id bigint, at double")
    earliest = found.groupBy("run").agg(F.min(F.struct("at", "email_id", "message")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = found.join(earliest, "run").where("message <> first.message").groupBy("thread", "message").agg(F.collect_list("run").alias("seen"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, m, x, b, s in zip(batch["thread"], batch["message"], batch["sender"], batch["body"], batch["seen"]):
                out.append((t, m, *_analysed(_lines(b), SeenRuns(t, set(s) if s is not None else set()), x)))
            yield pd.DataFrame(out, columns=["thread", "message", "flags", "starts", "keys"])

    read = firsts.join(seen, ["thread", "message"], "left").select("thread", "message", "sender", "body", "seen").mapInPandas(run, "thread string, message string, flags binary, starts array<int>, keys array<bigint>")
    return light.where("target").join(read, ["thread", "message"]).select("email_id", "sender", (F.col("place") == 1).alias("first"), "flags", "starts", "keys")


def new_line_numbers(emails: DataFrame, least_messages: int = 3, least_of_sender: int = 2) -> DataFrame:
    """(email_id, line_no): the non-blank lines of body_text that the sender newly wrote; line_no counts from 1.

    Reads email_id, message_id, subject, from_address, date, headers and body_text; other columns are ignored. Null
    and empty bodies give no rows. A message held twice counts under each email_id. Null dates are taken from the
    neighbour by email_id; null subjects make threads of those who write to each other.
    """
    subject = F.lower(bare_subject(F.col("subject")))
    sender = F.lower(F.coalesce(F.regexp_extract("from_address", r"([\w.+-]+@[\w.-]+)", 1), F.lit("")))
    people = F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(F.array(sender), F.coalesce(F.transform("to_addresses", lambda x: F.lower(F.regexp_extract(x, r"([\w.+-]+@[\w.-]+)", 1))), F.array().cast("array<string>"))))))
    rows = emails.where("email_id is not null").select(
        F.col("email_id").cast("bigint").alias("email_id"),
        F.coalesce("message_id", F.sha2(F.concat_ws("\x1f", "from_address", "body_text"), 256)).alias("message"),
        F.when(subject.rlike(r"^[^\p{L}\p{N}]*(?:no subject|ohne betreff|kein betreff|sans objet|sin asunto)?[^\p{L}\p{N}]*$"), people).otherwise(subject).alias("thread"),
        F.element_at("headers", "In-Reply-To").alias("parent"),
        F.col("from_address").alias("sender"),
        F.unix_micros("date").cast("double").alias("at"),
        F.coalesce("body_text", F.lit("")).alias("body"),
    )
    fields = ["email_id", "message", "at", "sender", "body"]
    light = rows.select("email_id", "message", "thread", "parent")
    replies = light.where("parent is not null").select(F.col("parent").alias("message"), F.col("thread").alias("of")).distinct()
    asked = cut(light.drop("parent").join(replies, "message").where("of <> thread").select("email_id", "of"))
    small = asked.count() <= MOST_BROADCAST
    parents = rows.join(F.broadcast(asked) if small else asked, "email_id").select(F.col("of").alias("thread"), F.lit(False).alias("target"), *fields)
    every = rows.select("thread", F.lit(True).alias("target"), *fields).unionByName(parents)
    analysed = cut(_threads(every))
    kept = ["email_id", "sender", "first", "flags", "starts", "keys"]
    large = analysed.where("flags is null")
    analysed = analysed.where("flags is not null").select(*kept) if large.isEmpty() else cut(analysed.where("flags is not null").select(*kept).unionByName(_large(large).select(*kept)))
    tails = analysed.select("email_id", "first", "sender", F.explode(F.arrays_zip("starts", "keys")).alias("p")).select("email_id", "first", "sender", "p.starts", "p.keys")
    by_sender = tails.where("first").groupBy("keys", "sender").agg(F.count("*").alias("n"))
    of_all = by_sender.groupBy("keys").agg(F.sum("n").alias("total"))
    often = by_sender.join(of_all, "keys").where(f"n >= {least_of_sender} or total >= {least_messages}").select(F.col("keys").alias("key"), F.col("sender").alias("by"))
    known = tails.join(often, (F.col("keys") == F.col("key")) & F.col("sender").eqNullSafe(F.col("by")), "left_semi")
    recurring = known.groupBy("email_id").agg(F.collect_set("starts").alias("recurring"))

    @F.pandas_udf("array<int>")
    def numbers(flags: pd.Series, again: pd.Series) -> pd.Series:
        return pd.Series([written(f, set(a) if a is not None else set()) for f, a in zip(flags, again)])

    return analysed.select("email_id", "flags").join(recurring, "email_id", "left").select("email_id", F.explode(numbers("flags", "recurring")).alias("line_no"))


def new_lines(emails: DataFrame, **options) -> DataFrame:
    """(email_id, line_no, line): the lines of new_line_numbers with their text."""
    bodies = emails.select(F.col("email_id").cast("bigint").alias("email_id"), F.split("body_text", "\n").alias("lines"))
    found = new_line_numbers(emails, **options).join(bodies, "email_id")
    return found.select("email_id", "line_no", F.regexp_replace(F.element_at("lines", F.col("line_no")), "\r$", "").alias("line"))
