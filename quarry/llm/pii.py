"""Replacing personal data by surrogates: keyed, of the same type and format, distinct.

Entities (e-mail and IP addresses, phone, card, bank and social security numbers, secrets,
and names after a title, then wherever the text goes on to mention them) are found by patterns. An entity's surrogate depends on the key
and its normal form alone, so that it is the same wherever the entity stands, however
written. Digits, letters and address parts are encrypted in their own format by a keyed
Feistel permutation, so distinct entities of a format have distinct surrogates; names are
drawn by script and gender, which is that of any title that the name bears in the corpus. What is left of collisions, of surrogates
with each other and with entities of the corpus, is found by one aggregation over all
distinct entities, and the entities concerned take another draw.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import materialise

_DIGITS = "0123456789"

# Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Nils Oscar Paul Rafael Simon Theo Victor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Мария".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Λεωνίδας Μάριος Νίκος Πέτρος Σπύρος Φώτης".split(),
    ("han", "m"): "健太 大輔 翔太 拓也 直樹 剛 誠 亮".split(),
    ("han", "f"): "花子 美咲 愛子 由美 恵子 陽子 玲奈 幸子".split(),
    ("greek", "f"): "Άννα Βάσω Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
}
#: Consonants and vowels of the syllables that make family names, by script.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу"), "greek": ("βγδζκλμνπρστφχ", "αεηιο"), "han": ("田中山木村林本井", "川野原口島崎谷沢")}
TITLES = {
    "m": "Mr|Mister|Sir|Herrn|Herr|Monsieur|M|Señor|Sr|Don|Κύριος|Господин".split("|"),
    "f": "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Doña|Κυρία|Госпожа".split("|"),
    "": "Dr|Prof|Professor|Doctor".split("|"),
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_TITLE = "|".join(sorted(_GENDER, key=lambda t: (-len(t), t)))
_CAP = r"(?:\p{Lu}[^\W\d_]+(?:[-'’][^\W\d_]+)*|[\p{Han}\p{Hiragana}\p{Katakana}]{1,8})"

#: Kinds of entities in order of precedence, and their patterns; group v is what is replaced.
PATTERNS = {
    "secret": r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)\b[\"']?\s*[:=]\s*[\"']?)(?P<secret>[A-Za-z0-9+/_\-.=]{8,})",
    "key": r"(?<![A-Za-z0-9])(?P<key>AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}|[0-9a-fA-F]{40,64})(?![A-Za-z0-9])",
    "email": r"(?P<email>(?<![\w.+-])[\w][\w.+-]{0,63}@(?:[\w-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))",
    "ip": r"(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\w)",
    "ip6": r"(?<![\w:])(?P<ip6>(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])",
    "card": r"(?<![\w.+-])(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])",
    "phone": r"(?<![\w.])(?P<phone>\+\d{1,3}(?: \| |[ .-])?(?:\(\d{1,4}\)(?: \| |[ .-])?)?\d{1,4}(?:(?: \| |[ .-])?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?:\(0\d{1,4}\)|0\d{1,4})[ /-]\d{2,4}(?:[ -]\d{2,4}){1,3}(?![ .-]?\d))(?!\w)",
    "name": rf"(?<!\w)(?P<title>{_TITLE})\.? (?P<name>{_CAP}(?: {_CAP}){{0,2}})",
}
_FINDERS = {k: (regex if k == "name" else re).compile(p) for k, p in PATTERNS.items()}
_SECRET_WORDS = ("token", "secret", "passw", "pwd", "api", "access", "private", "auth")
_KEY_HEADS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox")
_TITLE_ENDS = tuple(t + end for t in _GENDER for end in (" ", "."))
#: For texts with digits: where this finds nothing, neither does the pattern.
_HINTS = {
    "key": re.compile(r"[0-9a-fA-F]{40}"), "ip": re.compile(r"\d\.\d{1,3}\.\d"), "ip6": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]"), "iban": re.compile(r"[A-Z]{2}\d{2}"),
    "ssn": re.compile(r"\d-\d{2}-\d"), "card": re.compile(r"\d(?:[ -]?\d){12}"), "phone": re.compile(r"\+\d|\d\) ?\d|\d{3}[.-]\d{3}[.-]\d{4}|(?<![\w.])\(?0\d{1,4}\)?[ /-]\d"),
}


def _kinds(text: str):
    """The kinds of which the text may hold an entity, by quick looks."""
    digits = any(d in text for d in _DIGITS)
    if digits or any(w in text for w in ("assw", "ASSW", "pwd", "PWD")):
        low = text.lower()
        if any(w in low for w in _SECRET_WORDS):
            yield "secret"
    if any(h in text for h in _KEY_HEADS) or digits and _HINTS["key"].search(text):
        yield "key"
    if "@" in text:
        yield "email"
    if digits:
        for kind in ("ip", "ip6", "iban", "ssn", "card", "phone"):
            if _HINTS[kind].search(text):
                yield kind
    if any(t in text for t in _TITLE_ENDS):
        yield "name"


def _whole(kind: str, m) -> bool:
    """What a pattern alone can't tell of a match."""
    value = m[kind]
    if kind == "secret":  # a password may be words alone, if it is long
        return bool(re.search(r"\d", value)) or len(value) >= 12 and bool(re.match(r"(?i)pass|pwd", m[0]))
    if kind == "ip6":
        groups = [g for g in value.split(":") if g]
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return False
        return re.search(r"\d", value) is not None and (len(groups) > 2 or any(len(g) == 4 for g in groups))
    if kind == "phone" and value.lstrip("(").startswith("0"):
        return 9 <= sum(c.isdigit() for c in value) <= 12
    return True


def _later(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further mentions of the names found: the whole name, or its last word, from the first mention on. A last word that
    several names share is the latest one's. The context of these is title|name."""
    names = sorted((s, e, c) for s, e, k, c in found if k == "name")
    if not names:
        return []
    who: dict[str, list[tuple[int, str]]] = {}
    for s, e, title in names:
        full = " ".join(text[s:e].split())
        for word in {full, full.split()[-1]}:
            if len(word) > 2 or not word.isascii():
                who.setdefault(word, []).append((s, f"{title}|{full}"))
    if not who:
        return []
    taken = sorted((s, e) for s, e, _, _ in found)
    starts = [s for s, _ in taken]
    out, words = [], "|".join(map(re.escape, sorted(who, key=len, reverse=True)))
    for m in re.compile(rf"(?<!\w)(?:{words})(?!\w)").finditer(text, names[0][1]):
        i = bisect_right(starts, m.start()) - 1
        if i >= 0 and taken[i][1] > m.start() or i + 1 < len(taken) and taken[i + 1][0] < m.end():
            continue
        own = who[m[0]]
        at = bisect_left(own, (m.start(), "")) - 1
        if at >= 0:
            out.append((*m.span(), "name", own[at][1]))
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, context) of the entities of a text, in order, without overlap; of two
    that overlap, the kind that stands first in PATTERNS stays. context is a name's title, for a later mention
    title|name."""
    found: list[tuple[int, int, str, str]] = []
    for kind in _kinds(text):
        for m in _FINDERS[kind].finditer(text):
            if ahead := [s for s, e, _, _ in found if s < m.end(kind) and e > m.start(kind)]:
                m = _FINDERS[kind].match(text, m.start(), max(m.start(), min(ahead)))  # what stands before the other
                if m is None:
                    continue
            start, end = m.span(kind)
            if kind == "email":
                end = start + len(text[start:end].rstrip("."))
            if not _whole(kind, m):
                continue
            found.append((start, end, kind, m["title"] if kind == "name" else ""))
    return sorted(found + _later(text, found))


def normal(kind: str, value: str, context: str = "") -> str:
    """What makes two mentions one entity: digits of numbers, letters' case of addresses and hexadecimals."""
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "").upper()
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    if kind == "name":
        return " ".join((context.partition("|")[2] or value).split())
    if kind == "email" or re.fullmatch(r"[0-9a-fA-F]+", value):
        return value.lower()
    return value


def gender_of(key: bytes, entity: str, context: str) -> tuple[str, bool]:
    """The gender by a mention's title, and whether the title has one; else a keyed choice."""
    known = _GENDER.get(context.partition("|")[0], "")
    return known or "mf"[_prf(key, "gender", entity) % 2], bool(known)


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def permute(key: bytes, tweak: str, symbols: list[int], bases: list[int]) -> list[int]:
    """A keyed permutation of the mixed-base words of one shape: ten unbalanced Feistel rounds."""
    half = len(symbols) // 2
    left, right = symbols[:half], symbols[half:]
    bl, br = bases[:half], bases[half:]
    if not left:  # one symbol: a keyed rotation
        return [(symbols[0] + _prf(key, tweak)) % bases[0]] if symbols else []
    for r in range(10):
        side, other, base = (left, right, bl) if r % 2 == 0 else (right, left, br)
        f = _prf(key, tweak, r, len(symbols), other)
        for i in range(len(side)):
            f, d = divmod(f, base[i]) if f else (_prf(key, tweak, r, i, other), 0)
            side[i] = (side[i] + d) % base[i]
    return left + right


_SETS = (_DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = (_DIGITS + "abcdef", _DIGITS + "ABCDEF")


def _shaped(key: bytes, tweak: str, value: str, sets=_SETS) -> str:
    """value with every character of the sets permuted within its set; all else stands."""
    at = [(i, s) for i, c in enumerate(value) for s in [next((s for s in sets if c in s), None)] if s]
    out = list(value)
    shape = "".join("x" if any(c in s for s in sets) else c for c in value) + "".join(str(sets.index(s)) for _, s in at)
    for (i, s), d in zip(at, permute(key, f"{tweak}|{shape}", [s.index(value[i]) for i, s in at], [len(s) for _, s in at]), strict=True):
        out[i] = s[d]
    return "".join(out)


def _digits(key: bytes, tweak: str, digits: str) -> str:
    return _shaped(key, f"{tweak}|{len(digits)}", digits, (_DIGITS,))


def _luhn(body: str) -> str:
    """The check digit of a card number."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def _poured(digits: str, into: str) -> str:
    """into with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), into)


def _script(word: str) -> str:
    if regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}]", word):
        return "han"
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" or "ἀ" <= word[0] <= "῿" else "latin"


def surrogate(key: bytes, kind: str, entity: str, value: str, draw: int = 0, gender: str = "") -> str:
    """The replacement of a mention: entity is its normal form, value how it is written.

    draw counts how often the entity had to draw again; gender is that of a name.
    """
    tweak = f"{kind}|{draw}"
    if kind == "card":
        digits = _digits(key, tweak, entity[:-1])
        off = int(entity[-1]) - int(_luhn(entity[:-1]))  # 0 for a valid number: validity stays as it is
        last = str((int(_luhn(digits)) + off) % 10)
        return _poured(digits + last, value)
    if kind == "phone":
        plus = re.match(r"\+(\d{1,3})[ .()-]", value)
        lead = plus[1] if plus else ""
        return _poured(lead + _digits(key, f"{tweak}|{lead}", entity[len(lead) :]), value)
    if kind == "ssn":
        return _poured(_digits(key, tweak, entity), value)
    if kind == "ip":
        octets = list(map(int, entity.split(".")))
        return ".".join(map(str, permute(key, tweak, octets, [256] * 4)))
    if kind == "ip6":
        groups = [int(g, 16) for g in entity.split(":")]
        some = [i for i, g in enumerate(groups) if g]  # zeros stay, and with them the short form
        for i, g in zip(some, permute(key, f"{tweak}|{some}", [groups[i] - 1 for i in some], [(1 << 16) - 1] * len(some)), strict=True):
            groups[i] = g + 1
        text = ":".join(f"{g:x}" for g in groups)
        text = str(ipaddress.IPv6Address(text)) if "::" in value else text
        return text.upper() if value.upper() == value else text
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        name, _, tld = domain.rpartition(".")
        made = f"{_email_part(key, tweak + '|local', local)}@{_email_part(key, tweak + '|' + tld, name)}.{tld}"
        return made.upper() if value.isupper() else made
    if kind == "iban":
        country, rest = entity[:2], _shaped(key, f"{tweak}|{entity[:2]}", entity[4:], (_DIGITS, _SETS[2]))
        number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
        body = iter(f"{country}{98 - number % 97:02d}{rest}")
        return "".join(c if c == " " else next(body) for c in value)
    if kind in ("secret", "key"):
        if re.fullmatch(r"[0-9a-fA-F]+", value) and entity == value.lower():
            made = _shaped(key, f"{tweak}|hex", entity, (_HEX[0],))
            return made.upper() if value == value.upper() and value != value.lower() else made
        lead = re.match(r"AKIA|gh[pousr]_|sk-|xox[abpr]-|", value)[0]
        return lead + _shaped(key, f"{tweak}|{lead}", value[len(lead) :])
    if kind == "name":
        words = entity.split()
        script = _script(words[0])
        gender = gender or gender_of(key, entity, "")[0]
        # A family name alone draws as it does with a given name before it; a later mention may be the family name.
        part = words[-1] == value != entity
        given = [_given(key, f"{tweak}|{gender}", w, script, gender) for w in words[:-1]] if not part else []
        made = " ".join([*given, _syllables(key, tweak, words[-1], script, 6)])
        return made.upper() if value.isupper() else made
    raise ValueError(kind)


def _syllables(key: bytes, tweak: str, word: str, script: str, n: int) -> str:
    consonants, vowels = SYLLABLES[script]
    f, out = _prf(key, tweak, word), []
    for _ in range(n):
        f, c = divmod(f, len(consonants))
        f, v = divmod(f, len(vowels))
        out.append(consonants[c] + vowels[v])
    return "".join(out).capitalize()


def _given(key: bytes, tweak: str, word: str, script: str, gender: str) -> str:
    """A given name of the script and gender, and one of syllables that tells it apart."""
    names = GIVEN[script, gender]
    return f"{names[_prf(key, tweak, word) % len(names)]}-{_syllables(key, tweak + '|more', word, script, 3)}"


def _email_part(key: bytes, tweak: str, part: str) -> str:
    """Format-preserving for ASCII; for other scripts a keyed word of the same length."""
    if part.isascii():
        return _shaped(key, tweak, part)
    f = _prf(key, tweak, part)
    return "".join("abcdefghijklmnopqrstuvwxyz"[f // 26**i % 26] for i in range(max(8, len(part))))


_FORMS = "kind string, entity string, value string, own string, titled boolean"


def _forms(batches, key: bytes):
    """(kind, entity, value, own, titled) of each distinct way in which a batch writes an entity; own is the gender that a
    name has by this mention alone, titled whether by a title."""
    for batch in batches:
        seen = set()
        for text in batch.column(0).to_pylist():
            for start, end, kind, context in find(text) if text else ():
                entity = normal(kind, text[start:end], context)
                own = gender_of(key, entity, context) if kind == "name" else ("", False)
                seen.add((kind, entity, entity if kind == "name" else text[start:end], *own))
        columns = list(zip(*sorted(seen), strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.bool_()], strict=True)], names=["kind", "entity", "value", "own", "titled"])


def _made(batches, key: bytes):
    """Rows (kind, entity, value, gender, odd, draw) with the normal form of their surrogate."""
    for batch in batches:
        made = []
        for kind, entity, value, gender, _, draw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            made.append(normal(kind, surrogate(key, kind, entity, value, draw, gender or "")))
        yield batch.append_column("made", pa.array(made, pa.string()))


def _mentioned(batches):
    """(_row, kind, entity) of each distinct entity of a row."""
    for batch in batches:
        out = []
        for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out += {(row, k, normal(k, text[s:e], c)) for s, e, k, c in find(text)}
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["_row", "kind", "entity"])


def _replaced(batches, key: bytes, draws: dict | None, text_at: int):
    """Rows with their text replaced. Without draws the last column holds each row's own, and goes."""
    for batch in batches:
        texts, counts, kinds = [], [], []
        own = batch.column(batch.num_columns - 1).to_pylist() if draws is None else [None] * batch.num_rows
        batch = batch if draws is not None else batch.select(batch.schema.names[:-1])
        for text, mine in zip(batch.column(text_at).to_pylist(), own, strict=True):
            again = draws if draws is not None else {(d["kind"], d["entity"]): (d["draw"], d["gender"]) for d in mine or ()}
            if text is None:
                texts.append(None)
                counts.append(0)
                kinds.append([])
                continue
            out, last, got = [], 0, find(text)
            for start, end, kind, context in got:
                value = text[start:end]
                entity = normal(kind, value, context)
                draw, gender = again.get((kind, entity)) or (0, gender_of(key, entity, context)[0] if kind == "name" else "")
                out += [text[last:start], surrogate(key, kind, entity, value, draw, gender or "")]
                last = end
            texts.append("".join([*out, text[last:]]) if got else text)
            counts.append(len(got))
            kinds.append([k for _, _, k, _ in got])
        columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns)]
        yield pa.record_batch([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=[*batch.schema.names, "n_entities", "entity_kinds"])


#: Entities that draw again or have another gender than a mention tells, up to which they are broadcast; more are joined to the rows that mention them.
MAX_DRAWS = 100_000
#: Rounds without fewer clashes than ever before, after which there is no use in drawing again.
STUCK = 8


def draws(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """How often entities must draw again for surrogates to be distinct and not themselves entities, and the gender
    of names that the corpus mentions with different titles: that of a title that has one, of both the female one.

    Rows of kind, entity, draw int and gender, for the exceptions alone. Texts are read once; each
    round is one aggregation over the distinct entities of the corpus, and rounds go on until
    no surrogate clashes. Of entities with one surrogate the smallest keeps it. Formats are
    permuted, so that only a changed draw can make two of them equal. Where drawing doesn't
    help (a space that is full), there is an error.
    """
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    forms = materialise(texts.mapInArrow(lambda it: _forms(it, key), _FORMS).distinct())
    by_title = F.min(F.when(F.col("titled"), F.col("own")))
    names = forms.where("kind = 'name'").groupBy("kind", "entity").agg(F.coalesce(by_title, F.min("own")).alias("gender"), (F.min("own") < F.max("own")).alias("odd"))
    state = forms.select("kind", "entity", "value").distinct().join(names, ["kind", "entity"], "left")
    state = materialise(state.select("kind", "entity", "value", "gender", F.coalesce("odd", F.lit(False)).alias("odd"), F.lit(0).alias("draw")))
    real = state.select("kind", F.col("entity").alias("made")).distinct().withColumn("real", F.lit(True))
    fewest, stuck = None, 0
    while True:
        found = materialise(state.mapInArrow(lambda it: _made(it, key), "kind string, entity string, value string, gender string, odd boolean, draw int, made string"))
        taken = found.groupBy("kind", "made").agg(F.min("entity").alias("keeps"), F.max("entity").alias("most")).where("keeps <> most")
        clash = found.join(taken, ["kind", "made"], "left").join(real, ["kind", "made"], "left")
        clash = materialise(clash.where("(keeps is not null and entity <> keeps) or real").select("kind", "entity").distinct().withColumn("more", F.lit(1)))
        n = clash.count()
        if not n:
            return found.where("draw > 0 or odd").select("kind", "entity", "draw", "gender").distinct()
        stuck = stuck + 1 if fewest is not None and n >= fewest else 0
        if stuck == STUCK:
            raise ValueError(f"{n} surrogates collide, however often they are drawn")
        fewest = n if fewest is None else min(n, fewest)
        state = found.drop("made").join(clash, ["kind", "entity"], "left").withColumn("draw", F.col("draw") + F.coalesce("more", F.lit(0)))
        state = state.select("kind", "entity", "value", "gender", "odd", "draw")


def replace(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with the entities of the text replaced; all columns are kept.

    More columns: n_entities long, entity_kinds array<string> (in text order); input columns
    of those names are replaced. Null texts stay null and empty ones empty. An entity has one
    surrogate in all rows, so repeated rows stay alike, and ties of ids don't matter. No two entities share a
    surrogate, and none is an entity of the corpus; a space of surrogates that is full is an error. Texts of any
    length are taken whole.
    docs is read twice, without a shuffle of texts unless over MAX_DRAWS entities draw again.
    """
    docs = docs.drop("n_entities", "entity_kinds")
    again = draws(docs, key, text_col)
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_entities long, entity_kinds array<string>"
    few = again.limit(MAX_DRAWS + 1).collect()
    if len(few) <= MAX_DRAWS:
        sent = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["entity"]): (r["draw"], r["gender"]) for r in few})
        return docs.mapInArrow(lambda it: _replaced(it, key, sent.value, at), schema)
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()))
    texts = rows.select("_row", F.col(text_col).alias("text")).where("text is not null")
    own = texts.mapInArrow(_mentioned, "_row long, kind string, entity string").join(again, ["kind", "entity"])
    own = own.groupBy("_row").agg(F.collect_list(F.struct("kind", "entity", "draw", "gender")).alias("_draws"))
    return rows.join(own, "_row", "left").select(*docs.columns, "_draws").mapInArrow(lambda it: _replaced(it, key, None, at), schema)
