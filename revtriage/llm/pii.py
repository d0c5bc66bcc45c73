r"""Personal data and secrets replaced by surrogates (native DataFrame functions only).

Entities are found by one pattern per type.  An entity has one or more parts (an
e-mail address its local part and domain, a name its given names and surname);
each part gets a surrogate from a keyed hash of its kind and normal form:

* type-consistent: digits stay digits, letters letters, hexadecimal values
  hexadecimal; a valid card number gets one that passes its checksum; country
  codes, punctuation and spacing stay as they were written;
* names keep the gender that their title or, in Cyrillic and Greek, their ending
  shows, and their script (a script without syllables here gets letters of the
  word itself); initials and particles ("van", "de") stay as they were written;
* coreference: equal normal forms (case, spacing, punctuation and titles left
  out) have one surrogate in the whole corpus, and a surname alone, or one half
  of a double one, is replaced as it is in a full name.  A name is found by its title; other capitalised
  mentions of its words in the same text are then replaced too, each counted as
  an entity.  Scripts without capitals, where a title tells no name apart from
  the words after it, are not searched for names;
* distinctness: no two parts of a kind share a surrogate and no surrogate is a
  part that occurs in the corpus.  Parts that collide take their next attempt
  until none does; who settled first keeps his, so the outcome depends neither
  on the order of rows nor on their partitions.

Plan: the table is written down once with each text's entities; only the
entities are exploded, made distinct and settled (a dictionary as large as the
number of distinct parts, never on the driver); a join brings the surrogates to
the entities (a hot entity's partition is split by adaptive execution), and only
texts that hold entities are joined with theirs and glued anew.

Defined results: a null text stays null and an empty one empty; texts without
entities are unchanged to the byte; repeated rows and rows with a null id are
kept, each on its own; all other columns are kept as they are, and the count of
entities gets underscores appended to its name until it clashes with none; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

KEY = "surrogates"
MAX_ATTEMPTS = 40

MEN = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "M", "Señor", "Sr", "Don", "г-н", "господин", "κ", "κύριος")
WOMEN = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "г-жа", "госпожа", "κα", "κυρία")
OTHER = ("Dr", "Prof")

#: First choices of given names by gender and script; further ones are made of syllables.
GIVEN = {
    "man_latin": ("Adrian", "Benedict", "Casper", "Dominic", "Emil", "Florian", "Gregor", "Hector", "Isidor", "Julian", "Konrad", "Lorenz", "Marius", "Oscar", "Quentin", "Rupert"),
    "woman_latin": ("Adele", "Beatrix", "Clara", "Dorothea", "Elena", "Frida", "Greta", "Helena", "Irma", "Judith", "Klara", "Leonie", "Mathilde", "Odette", "Petra", "Rosalie"),
    "any_latin": ("Alex", "Bente", "Charlie", "Dana", "Eike", "Finn", "Jamie", "Jona", "Kim", "Luca", "Maxi", "Noa", "Robin", "Sascha", "Sky", "Toni"),
    "man_cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Матвей", "Олег", "Павел", "Роман", "Семён", "Тимур"),
    "woman_cyrillic": ("Алла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Зоя", "Инна", "Кира", "Лада", "Майя", "Нина", "Ольга", "Полина", "Рита", "Софья"),
}
GIVEN |= {
    "man_greek": ("Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θανάσης", "Κώστας", "Λευτέρης"),
    "woman_greek": ("Αθηνά", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα"),
}
#: Syllables of invented names by script: heads, middles, and the endings that show a gender.
HEADS = {
    "latin": ("Al", "Bran", "Cor", "Dal", "Er", "Fen", "Gar", "Hol", "Ker", "Lan", "Mor", "Nor", "Os", "Pel", "Ros", "Var"),
    "cyrillic": ("Бар", "Вел", "Гор", "Дар", "Зар", "Кал", "Лук", "Мар", "Нов", "Ор", "Пал", "Рад", "Сав", "Тар", "Фад", "Яр"),
    "greek": ("Αν", "Βασ", "Γαλ", "Δελ", "Ζαρ", "Θαλ", "Καρ", "Λαμ", "Μαν", "Νικ", "Παρ", "Ραλ", "Σαρ", "Ταμ", "Φαλ", "Χαρ"),
}
MIDDLES = {
    "latin": ("ba", "do", "ga", "le", "mi", "na", "ro", "ta", "be", "di", "ge", "lo", "ma", "ni", "ra", "to"),
    "cyrillic": ("ба", "ви", "го", "де", "за", "ка", "ли", "мо", "на", "по", "ра", "са", "ти", "ва", "ми", "ло"),
    "greek": ("βα", "γο", "δε", "θα", "κα", "λι", "μα", "νο", "πα", "ρα", "σι", "τα", "φο", "χα", "λε", "μι"),
}
GIVEN_ENDS = {
    "man_latin": ("rik", "mund", "bert", "win", "nio", "rus"),
    "woman_latin": ("lina", "rike", "bella", "trude", "nia", "ra"),
    "any_latin": ("ne", "ry", "ly", "mi", "rin", "lou"),
    "man_cyrillic": ("слав", "мир", "рий", "тин", "лан", "мин"),
    "woman_cyrillic": ("слава", "мира", "рия", "тина", "лана", "мила"),
    "man_greek": ("νης", "ρης", "λος", "κης", "μος", "στος"),
    "woman_greek": ("νη", "ρα", "λία", "κη", "μία", "στα"),
}
SURNAME_ENDS = {
    "latin": ("bury", "croft", "den", "feld", "gate", "ham", "lund", "mann", "mont", "ner", "shaw", "stein", "ton", "vale", "well", "wick"),
    "cyrillic": ("ев", "ин", "ов", "ский", "цев", "нов", "кин", "лин", "рин", "тов", "шин", "хов", "дин", "гин", "вич", "енко"),
    "cyrillic_woman": ("ева", "ина", "ова", "ская", "цева", "нова", "кина", "лина", "рина", "това", "шина", "хова", "дина", "гина", "кова", "сова"),
    "greek": ("ίδης", "άκης", "όπουλος", "άτος", "ούλης", "άκος", "ιάδης", "έλης"),
    "greek_woman": ("ίδου", "άκη", "οπούλου", "άτου", "ούλη", "άκου", "ιάδου", "έλη"),
}
#: Endings by which a surname is a woman's.
WOMANS = r"(?:ова|ева|ёва|ина|ына|ская|цкая|ная)$"
WOMANS_GREEK = r"(?:ου|άκη|έλη)$"

_TITLE = r"\b(?:" + "|".join(MEN + WOMEN + OTHER) + r")\b\.?"
_SECRET = r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_.~-]{6,}"
_ACCESS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
_EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]+)*\.[\p{L}\p{M}]{2,24}"
_IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Lengths of account numbers by country; others take as many groups of four as there are.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV",
    29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}


def _iban(n: int, countries: str) -> str:
    fours, rest = divmod(n - 4, 4)
    return rf"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


_IBAN = r"\b(?:" + "|".join(_iban(n, c) for n, c in IBAN_LENGTHS.items()) + r")\b|\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"

#: Country codes (E.164), and digits after them where all numbers of a country have equally many.
COUNTRY_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
NATIONAL_DIGITS = {8: "45|47|65|370|371|386|852", 9: "27|31|33|34|40|41|48|51|56|61|66|212|213|351|353|380|420|421|886|966|971|972", 10: "1|7|30|44|52|57|63|90|91|92", 11: "86"}

_H = "[0-9A-Fa-f]{1,4}"
_IP6 = (
    r"(?<![\p{L}\p{N}_:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*+)(?=[A-Fa-f:]*[0-9])(?:"
    + "|".join([f"(?:{_H}:){{7}}{_H}", *[f"(?:{_H}:){{1,{7 - k}}}(?::{_H}){{1,{k}}}" for k in range(1, 7)], f":(?::{_H}){{1,7}}", f"(?:{_H}:){{1,7}}:"])
    + r")(?![\p{L}\p{N}_:])(?!\.[0-9])"
)

#: A group of digits ends at none of these: it would be cut out of a longer number.
_STRICT = r"(?![0-9])(?![.-][0-9])"
_HOME = r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])|(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{4}" + _STRICT
_CARD_FIXED = (
    r"(?:62|5[06-9]|6[37])[0-9]{2}(?:[ -][0-9]{4}){3}[ -][0-9]{3}" + _STRICT + "|"
    r"(?:[3-6][0-9]|2[2-7])[0-9]{2}(?:[ -][0-9]{4}){3}(?![0-9])|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])|[0-9]{13,19}(?![0-9])"
)
#: Before a separator in a number of unknown grouping: not the blank before another entity.
_NO_NEXT = f"(?! (?:{_IP}|{_HOME}|{_SSN}|{_CARD_FIXED}))"
_SEP = r"(?:[ .-]?\(|\)[ .-]?|[ .-])?"
_ABROAD = (
    "|".join(rf"(?:{codes})(?:[ .-]?\(0\))?(?:{_SEP}[0-9]){{{n}}}(?![0-9])" for n, codes in NATIONAL_DIGITS.items())
    + rf"|(?:{COUNTRY_CODE})(?:[ .-]?\(0\))?(?:{_NO_NEXT}{_SEP}[0-9]){{7,11}}{_STRICT}"
    + rf"|[0-9]{{1,3}}[ .-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})(?:{_NO_NEXT}[ .-]?[0-9]{{2,4}}){{2,3}}{_STRICT}"
    + rf"|[0-9]{{1,3}}[ .-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})(?:{_NO_NEXT}[ .-]?[0-9]{{2,4}}){{2,3}}(?![0-9])"
)
_PHONE = rf"(?<![0-9])\+(?:{_ABROAD})|{_HOME}"
_CARD = rf"(?<![0-9.-])(?:{_CARD_FIXED}|[0-9]{{4}}(?:{_NO_NEXT}[ -][0-9]{{4}}){{3}}(?![0-9])|[0-9](?:{_NO_NEXT}[ -]?[0-9]){{12,18}}{_STRICT}|[0-9](?:{_NO_NEXT}[ -]?[0-9]){{12,18}}(?![0-9]))"

#: A word of a name: inner capitals and apostrophes belong to it, a possessive ending does not.
WORD = r"(?<![\p{L}\p{M}\p{N}_])\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]++(?:['’]\p{Lu}[\p{L}\p{M}]++)*+(?![\p{N}_])"
_PARTICLE = "(?:van|von|der|den|de|la|las|los|del|della|di|da|dos|du|le|el|al|bin|ibn|zu|ter|ten) "
_BETWEEN = r"(?: (?:\p{Lu}\. ?){0,3}(?:" + _PARTICLE + r"){0,3}|-)"
#: No word of a name: another title ("Don" is a given name as well), or the start of another entity.
_STOP = r"(?:" + "|".join(t for t in MEN + WOMEN + OTHER if t != "Don") + r")\b"
_OTHER_STARTS = f"{_SECRET}|{_ACCESS_KEY}|{_EMAIL}"
_FIRST_WORD = rf"(?!{_STOP}\.? \p{{Lu}}|{_OTHER_STARTS}){WORD}"
_NEXT_WORD = rf"(?!{_STOP}|{_OTHER_STARTS}){WORD}"
#: Type, and pattern of an entity.  Each starts at a place that a look-behind
#: or its first character fixes, so that a long word is not tried at every place.
PATTERNS = (
    ("secret", _SECRET),
    ("access_key", _ACCESS_KEY),
    ("email", _EMAIL),
    ("iban", _IBAN),
    ("ip", _IP),
    ("ip6", _IP6),
    ("phone", _PHONE),
    ("ssn", _SSN),
    ("card", _CARD),
    ("name", _TITLE + r" (?:\p{Lu}\. ?){0,3}(?:" + _PARTICLE + r"){0,3}" + _FIRST_WORD + rf"(?:{_BETWEEN}{_NEXT_WORD}){{0,3}}"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What can occur in a text without digits, and without an @, a colon and an equals sign besides.
_OF = dict(PATTERNS)
NO_DIGITS = "|".join(f"(?:{_OF[k]})" for k in ("secret", "access_key", "email", "name"))
NAMES = _OF["name"]
_SECRET_HEAD = r"^(.*?[:=]\s{0,3}[\"']?)[A-Za-z0-9+/_.~-]{6,}$"


def _array(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join("'" + v + "'" for v in values) + ")"


def _sql(pattern: str) -> str:
    """``pattern`` as a SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _type_of(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _plain(w: str) -> str:
    """SQL: normal form of a word of a name."""
    return f"replace(lower({w}), '’', chr(39))"


def _name_kind() -> str:
    """SQL: kind of the i-th word w of a name, whose last ``_last`` words are its surname."""
    script = "CASE WHEN w rlike '\\\\p{IsCyrillic}' THEN 'cyrillic' WHEN w rlike '\\\\p{IsGreek}' THEN 'greek' WHEN w rlike '\\\\p{IsLatin}' THEN 'latin' ELSE 'other' END"
    woman = f"CASE WHEN w rlike '{WOMANS}' OR w rlike '{WOMANS_GREEK}' THEN '_woman' ELSE '' END"
    # A name without a gendered title shows its own where its script's names do.
    gender = f"CASE WHEN _gender <> 'any' OR {script} NOT IN ('cyrillic', 'greek') THEN _gender WHEN w rlike '[аяάαηή]$' THEN 'woman' ELSE 'man' END"
    return f"IF(i >= size(_words) - _last, concat('surname_', {script}, {woman}), concat('given_', {gender}, '_', {script}))"


#: Per entity row (type, raw): its parts (kind, normal form).
PARTS = f"""
CASE type
 WHEN 'secret' THEN array(struct('secret' AS kind, regexp_replace(raw, '^.*?[:=]\\\\s{{0,3}}["\\']?', '') AS canon))
 WHEN 'access_key' THEN array(struct('access_key' AS kind, raw AS canon))
 WHEN 'email' THEN array(struct('mailbox' AS kind, lower(substring_index(raw, '@', 1)) AS canon), struct('domain' AS kind, lower(substring_index(raw, '@', -1)) AS canon))
 WHEN 'iban' THEN array(struct('iban' AS kind, replace(raw, ' ', '') AS canon))
 WHEN 'ip' THEN array(struct('ip' AS kind, raw AS canon))
 WHEN 'ip6' THEN array(struct('ip6' AS kind, array_join(transform(concat(_left, array_repeat('0', 8 - size(_left) - size(_right)), _right), x -> lpad(x, 4, '0')), ':') AS canon))
 WHEN 'phone' THEN array(struct(concat('phone', length(regexp_extract(raw, '^\\\\+({COUNTRY_CODE})', 1))) AS kind, {_digits("raw")} AS canon))
 WHEN 'name' THEN transform(_words, (w, i) -> struct({_name_kind()} AS kind, {_plain("w")} AS canon))
 ELSE array(struct(type AS kind, {_digits("raw")} AS canon))
END
"""


def _byte(i: str) -> str:
    """SQL: the i-th (from 0, cyclic) byte of the hash _h."""
    return f"cast(conv(substring(_h, 2 * pmod({i}, 32) + 1, 2), 16, 10) AS int)"


def _shaped(x: str) -> str:
    """SQL: ``x`` with its digits and ASCII letters replaced by ones from _h."""
    b = _byte("i")
    one = f"CASE WHEN c rlike '[0-9]' THEN cast({b} % 10 AS string) WHEN c rlike '[A-Z]' THEN chr(65 + {b} % 26) WHEN c rlike '[a-z]|\\\\p{{L}}' THEN chr(97 + {b} % 26) ELSE c END"
    return f"array_join(transform(split({x}, ''), (c, i) -> {one}), '')"


def _luhn(x: str) -> str:
    """SQL: Luhn sum of the digits of ``x`` modulo 10."""
    d = "cast(c AS int)"
    doubled = f"IF({d} > 4, 2 * {d} - 9, 2 * {d})"
    return f"aggregate(transform(reverse(split({x}, '')), (c, i) -> IF(i % 2 = 1, {doubled}, {d})), 0, (s, v) -> s + v) % 10"


def _card() -> str:
    """SQL: another number of the same length and first digit; passes Luhn's check if ``canon`` does."""
    body = f"concat(substring(canon, 1, 1), substring({_shaped('canon')}, 2, length(canon) - 2))"
    check = f"transform(array({body}), b -> concat(b, cast((10 - {_luhn('concat(b, 0)')}) % 10 AS string)))[0]"
    free = f"concat(substring(canon, 1, 1), substring({_shaped('canon')}, 2))"
    return f"IF({_luhn('canon')} = 0, {check}, {free})"


def _pick(values: tuple[str, ...], i: int) -> str:
    return f"{_array(values)}[{_byte(str(i))} % {len(values)}]"


def _composed(script: str, ends: tuple[str, ...], first: int) -> str:
    """SQL: a name of syllables, with more middles on each attempt after ``first``."""
    middles = MIDDLES[script]
    middle = f"array_join(transform(sequence(0, greatest(_attempt - {first}, 0)), i -> IF(i = 0, '', {_array(middles)}[{_byte('i + 2')} % {len(middles)}])), '')"
    return f"concat({_pick(HEADS[script], 0)}, {middle}, {_pick(ends, 1)})"


def _name_sql() -> str:
    cases = [f"WHEN 'surname_{which}' THEN {_composed(which.removesuffix('_woman'), ends, 0)}" for which, ends in SURNAME_ENDS.items()]
    for which, names in GIVEN.items():
        cases.append(f"WHEN 'given_{which}' THEN IF(_attempt = 0, {_pick(names, 0)}, {_composed(which.split('_')[1], GIVEN_ENDS[which], 1)})")
    # Of a script without syllables here: letters of the word itself, more of them on each attempt.
    own = f"initcap(array_join(transform(sequence(1, length(canon) + _attempt), i -> substring(canon, 1 + {_byte('i')} % length(canon), 1)), ''))"
    return " ".join(cases) + f" ELSE IF(kind LIKE '%\\_other%', {own}, {_shaped('canon')})"


#: Surrogate of a dictionary row (kind, canon, _attempt) by its hash _h.
SURROGATE = f"""
CASE kind
 WHEN 'secret' THEN IF(canon rlike '^[0-9a-f]+$', substring(repeat(_h, cast(length(canon) / 64 AS int) + 1), 1, length(canon)), {_shaped("canon")})
 WHEN 'access_key' THEN concat(substring(canon, 1, 4), substring({_shaped("canon")}, 5))
 WHEN 'mailbox' THEN concat({_shaped("canon")}, IF(_attempt < 3, '', concat('.', substring(_h, 1, _attempt))))
 WHEN 'domain' THEN concat({_shaped("substring(canon, 1, length(canon) - length(substring_index(canon, '.', -1)) - 1)")}, IF(_attempt < 3, '', substring(_h, 1, _attempt)), '.', substring_index(canon, '.', -1))
 WHEN 'iban' THEN concat(substring(canon, 1, 2), substring({_shaped("canon")}, 3))
 WHEN 'ip' THEN concat_ws('.', {", ".join(f"cast(1 + {_byte(str(i))} % 254 AS string)" for i in range(4))})
 WHEN 'ip6' THEN concat_ws(':', {", ".join(f"substring(_h, {4 * i + 1}, 4)" for i in range(8))})
 {" ".join(f"WHEN 'phone{n}' THEN concat(substring(canon, 1, {n}), substring({_shaped('canon')}, {n + 1}))" for n in range(4))}
 WHEN 'card' THEN {_card()}
 {_name_sql()}
END
"""

#: Characters of ``raw`` with the digits (letters too for account numbers) taken in turn from the surrogate.
_FILLED = """
array_join(transform(split(raw, ''), (c, i) -> IF(c rlike _slot,
  substring(_parts[0].surrogate, length(regexp_replace(substring(raw, 1, i + 1), _other, '')), 1), c)), '')
"""
RENDERED = f"""
CASE type
 WHEN 'secret' THEN concat(regexp_extract(raw, '{_SECRET_HEAD.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'")}', 1), _parts[0].surrogate)
 WHEN 'email' THEN concat(_parts[0].surrogate, '@', _parts[1].surrogate)
 WHEN 'name' THEN concat(substring_index(raw, ' ', 1), ' ', array_join(zip_with(split(substring(raw, length(substring_index(raw, ' ', 1)) + 2), {_sql(WORD)}, -1), _parts, (s, p) -> concat(s, coalesce(p.surrogate, ''))), ''))
 WHEN 'ip' THEN _parts[0].surrogate
 WHEN 'ip6' THEN _parts[0].surrogate
 WHEN 'access_key' THEN _parts[0].surrogate
 ELSE {_FILLED}
END
"""


def with_parts(entities: DataFrame) -> DataFrame:
    """Adds ``parts`` to entity rows with a column ``raw``."""
    title = F.regexp_replace(F.substring_index("raw", " ", 1), r"\.$", "")
    gender = F.when(title.isin(*MEN), "man").when(title.isin(*WOMEN), "woman").otherwise("any")
    x = entities.withColumn("type", _type_of(F.col("raw"))).withColumn("_gender", gender)
    x = x.withColumn("_words", F.regexp_extract_all(F.regexp_replace("raw", r"^\S+ ", ""), F.lit(WORD), F.lit(0)))
    # A double surname is one: all words after the last blank are the surname's.
    x = x.withColumn("_last", F.size(F.regexp_extract_all(F.substring_index("raw", " ", -1), F.lit(WORD), F.lit(0))))
    for name, i in (("_left", 1), ("_right", 2)):
        x = x.withColumn(name, F.expr(f"filter(split(split_part(lower(raw), '::', {i}), ':'), x -> x <> '')"))
    return x.withColumn("parts", F.expr(PARTS)).drop("_gender", "_words", "_last", "_left", "_right")


#: A gap between entities whose words are looked up among the names of its text (map _names), as they are written there or in capitals.
_MENTIONED = f"_names[{_plain('w')}]"
_NAMED = f"coalesce(IF(w = upper(w), upper({_MENTIONED}), {_MENTIONED}), w)"
_WORDS_OF = f"regexp_extract_all(g, {_sql(WORD)}, 0)"
MENTIONS = f"aggregate(_gaps, 0, (n, g) -> n + size(filter({_WORDS_OF}, w -> {_MENTIONED} IS NOT NULL)))"
RENAMED = f"transform(_gaps, g -> array_join(zip_with(split(g, {_sql(WORD)}, -1), {_WORDS_OF}, (s, w) -> concat(s, coalesce({_NAMED}, ''))), ''))"


def settle(parts: DataFrame, key: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Dictionary kind, canon, surrogate of distinct parts, free of collisions."""
    x = materialise(parts.select("kind", "canon").distinct(), "parts")
    real = x.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("_real"))
    x = x.withColumn("_attempt", F.lit(0)).withColumn("_settled", F.lit(False)).withColumn("surrogate", F.lit(""))
    for _ in range(max_attempts):
        h = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon", F.col("_attempt").cast("string")).cast("binary"), 256)
        x = x.withColumn("_h", h).withColumn("surrogate", F.when(F.col("_settled"), F.col("surrogate")).otherwise(F.expr(SURROGATE))).drop("_h")
        rank = F.concat(F.when(F.col("_settled"), "0").otherwise("1"), "canon")
        first = x.groupBy("kind", "surrogate").agg(F.min(rank).alias("_first"))
        y = x.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        good = F.col("_settled") | (F.col("_real").isNull() & (F.col("_first") == rank))
        y = y.select("kind", "canon", "surrogate", good.alias("_settled"), F.when(good, F.col("_attempt")).otherwise(F.col("_attempt") + 1).alias("_attempt"))
        x = materialise(y, "surrogates")
        if x.where(~F.col("_settled")).isEmpty():
            return x.select("kind", "canon", "surrogate")
    raise RuntimeError(f"surrogates still collide after {max_attempts} attempts")


def found_in(text: Column) -> Column:
    """The entities of a text.  Cheap looks at the whole text first tell which
    types it can hold at all; the others' patterns are left out, which changes
    no match."""
    digits = text.rlike("[0-9]")
    signs = text.contains("@") | text.contains(":") | text.contains("=") | text.contains("AKIA") | text.contains("ASIA")
    all_of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(digits, all_of(ANY)).when(signs, all_of(NO_DIGITS)).when(text.rlike(_TITLE + r" [\p{Lu}\p{Ll}]"), all_of(NAMES)).when(text.isNotNull(), F.array().cast("array<string>"))


def replace_pii(docs: DataFrame, text_col: str = "text", key: str = KEY, count_col: str = "n_entities") -> DataFrame:
    """``docs`` with the entities of the text column replaced, and their number as a last column."""
    count_col, found_col, row_col = (free_name(n, docs) for n in (count_col, "_pii_found", "_pii_row"))
    text = F.col(f"`{text_col}`")
    rows = docs.withColumn(found_col, found_in(text)).withColumn(row_col, F.monotonically_increasing_id())
    rows = materialise(rows, "with-entities", compression="zstd")
    number = F.greatest(F.coalesce(F.size(found_col), F.lit(0)), F.lit(0))  # of a null text the size is null or -1
    holders = rows.where(number > 0)
    entities = holders.select(F.col(row_col).alias("_row"), F.posexplode(found_col).alias("_pos", "raw"))
    entities = materialise(with_parts(entities), "entities")
    parts = entities.select("_row", "_pos", F.posexplode("parts").alias("_part", "_x")).select("_row", "_pos", "_part", "_x.kind", "_x.canon")
    dictionary = settle(parts, key)
    named = parts.join(dictionary, ["kind", "canon"]).groupBy("_row", "_pos").agg(F.sort_array(F.collect_list(F.struct("_part", "surrogate"))).alias("_parts"))
    account = F.col("type") == "iban"
    rendered = (
        entities.drop("parts")
        .join(named, ["_row", "_pos"])
        .withColumn("_slot", F.when(account, "[A-Z0-9]").otherwise("[0-9]"))
        .withColumn("_other", F.when(account, "[^A-Z0-9]").otherwise("[^0-9]"))
        .withColumn("_new", F.expr(RENDERED))
    )
    per_row = rendered.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", "_new"))).alias("_new"))
    rank = F.struct(~F.col("kind").startswith("surname"), "kind", "surrogate")
    words = parts.where("kind LIKE 'surname%' OR kind LIKE 'given%'").select("_row", "kind", "canon").distinct().join(dictionary, ["kind", "canon"])
    words = words.groupBy("_row", "canon").agg(F.min(rank)["surrogate"].alias("_s"))
    names = words.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("canon", "_s"))).alias("_names"))
    per_row = per_row.join(names, "_row", "left")
    others = F.struct(row_col, *[f"`{c}`" for c in docs.columns if c != text_col]).alias("_others")
    texts = holders.select(F.col(row_col).alias("_row"), F.split(text, ANY, -1).alias("_gaps"), number.alias("_n"), others).join(per_row, "_row")
    has_names = F.col("_names").isNotNull()
    texts = texts.withColumn("_n", F.col("_n") + F.when(has_names, F.expr(MENTIONS)).otherwise(0)).withColumn("_gaps", F.when(has_names, F.expr(RENAMED)).otherwise(F.col("_gaps")))
    glued = F.array_join(F.zip_with("_gaps", F.col("_new")["_new"], lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    changed = texts.select(*[(glued if c == text_col else F.col("_others").getField(c)).alias(c) for c in docs.columns], F.col("_n").alias(count_col))
    unchanged = rows.where(number == 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).alias(count_col))
    return changed.unionByName(unchanged)
