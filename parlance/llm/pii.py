"""PII surrogates: detected entities get keyed replacements of their own type and form.

The same entity has the same surrogate in every document (coreference), different
ones have different surrogates (checked over the whole corpus, with another draw
on a collision), and no surrogate is an entity of the corpus; only given names of
the lists are turned among themselves, so that they stay names of their gender. Digits stay digits,
letters letters of the same case, names keep their script and gender, cards pass
the Luhn check and IBANs theirs, private addresses stay private. All of it is DataFrame functions; only entities are shuffled, and
the texts of documents that hold any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh

#: Given names by script and gender; each is replaced by another of its list.
GIVEN = {
    ("latin", "female"): "Maria Anna Emma Julia Laura Sarah Sophie Claire Marie Camille Lucia Carmen Elena Isabel Katharina Sabine Ursula Monika Emily Olivia Jessica Jennifer Elizabeth Margaret".split(),
    ("latin", "male"): "John James Michael Robert William David Thomas Peter Hans Karl Stefan Wolfgang Pierre Jean Michel Antoine Carlos Juan Miguel Pablo Diego Alejandro George Daniel".split(),
    ("cyrillic", "female"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "male"): "Иван Дмитрий Сергей Алексей Андрей Михаил Николай Владимир".split(),
    ("greek", "female"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Δήμητρα".split(),
    ("greek", "male"): "Γεώργιος Ιωάννης Δημήτριος Νικόλαος Παναγιώτης Χρήστος".split(),
}
#: Titles, and particles of surnames, which stay as they are.
TITLES = "Mr. Mrs. Ms. Dr. Prof. Mme. Mlle. Sr. Sra. Miss Herr Frau Monsieur Madame Señor Señora".split()
PARTICLES = "von van de del der den da di la le bin al".split()
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo wa wi zo".split(),
    "cyrillic": "ба бо ва ве го да де ди жа за ка ко ла ле ли ло ма ми на ни но па по ра ре ро са се со та те ти то ха".split(),
    "greek": "βα βο γα γε δα δε δο ζα θα θε κα κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε σα σε τα τε το φα χα".split(),
}
ENDINGS = {"latin": ("", ""), "cyrillic": ("ова", "ов"), "greek": ("ου", "ος")}


def any_of(words: list[str]) -> str:
    """A pattern for any of words that shares their common starts, so that a mismatch shows at the first letters."""
    parts = []
    for first in sorted({w[0] for w in words if w}):
        parts.append(("\\" + first if first in ".()" else first) + any_of([w[1:] for w in words if w.startswith(first)]))
    if not parts:
        return ""
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return f"(?:{body})?" if "" in words else body


#: The countries of IBANs by length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return any_of(countries.split()) + rf"\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: An IBAN of its country's length; or of any code and length, in groups that hold a digit but for the first. Eight digits keep words in capitals out.
_IBAN = (
    r"(?=[A-Z]{2}\d{2}(?: ?[A-Z]{0,12} ?\d){6})(?:(?:"
    + "|".join(_iban_pattern(*x) for x in IBAN_LENGTHS.items())
    + r")(?![0-9A-Za-z])|[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?:[A-Z0-9]{4}| (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){2,6}(?: \d{1,3}|[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
)
_NAMES = [x for names in GIVEN.values() for n in names for x in (n, n.upper())]
_NAME, _TITLE = any_of(_NAMES), any_of(TITLES)
_SURNAME = r"\p{Lu}(?:\p{L}{0,3}['’])?\p{L}+(?:['’]\p{L}{2,})?(?:-\p{Lu}(?:\p{L}{0,3}['’])?\p{L}+)*"
#: A given name of the lists, alone or joined by hyphens to others; one or two such, or an initial beside it.
_GIVEN = rf"{_NAME}(?:-\p{{Lu}}\p{{L}}+)*(?: {_NAME}(?:-\p{{Lu}}\p{{L}}+)*| \p{{Lu}}\.)?"
_PARTICLES = rf"(?: (?:{'|'.join(PARTICLES)}))*"
#: Words after which a name of unlisted words stands.
SAYS_NAME = "Name:|name is|Name is|Author:|Contact:|Attn:|Signed:|dear|Dear|Sincerely,|Regards,|regards,|I am|I’m|I'm".split("|")
_SAYS_NAME = rf"(?<=(?:{'|'.join(SAYS_NAME)}) )"
#: Frequent surnames that are written as one Han character, and characters of given names.
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗"
HAN_GIVEN = "明伟芳娜敏静丽强磊军洋勇艳杰涛超华平刚玲"
#: Kinds in the order in which a found string is told to be of one; each is a pattern for Java.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}(?![A-Za-z0-9-])",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "key": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+)(?![0-9A-Za-z])",
    "secret": r"(?<=[\"'])(?<=(?:token|secret|password|api_key) ?[=:] ?[\"'])[^\"'\s]{8,}+(?=[\"'])",
    "iban": rf"(?<![0-9A-Za-z]){_IBAN}",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![0-9]|\.[0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{3,4}:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "phone": r"(?=[+(\d])(?:(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w.-])(?:\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|\d{3}[-. ]\d{3}[-. ]\d{4}(?![\w-]))"
    r"|(?<![\w.+/-])0[1-9](?:(?:[ .]\d{2}){4}(?![\w/])|\d{1,3}[ /-]\d{5,8}(?![\w/-])))",
    "person": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_TITLE} )?{_GIVEN}{_PARTICLES} {_SURNAME}|{_TITLE} (?:\p{{Lu}}\p{{L}}+ ){{0,2}}{_SURNAME}"
    rf"|{_SAYS_NAME}{_SURNAME}(?: \p{{Lu}}\.)?{_PARTICLES} {_SURNAME}|{_SURNAME} {_SURNAME}(?= ?[<(][A-Za-z0-9._%+-]{{1,64}}@))(?!\p{{L}})",
    "han": rf"[{HAN_SURNAMES}](?<=(?:我叫|我是|姓名：|姓名:).)\p{{IsHan}}{{1,2}}(?!\p{{IsHan}})|[{HAN_SURNAMES}]\p{{IsHan}}{{1,2}}(?=先生|女士|小姐|老师)",
}
#: No entity begins within a word of ASCII letters, which rules most places out at the first look.
PATTERN = r"(?<![A-Za-z])(?:" + "|".join(KINDS.values()) + ")"
#: A text without a match of this holds no entity: a digit, an @, a quoted secret, a key's start, a given name or title as a word, or words that come with names.
HINT = (
    rf"[0-9@]|[=:] ?[\"']|(?<![A-Za-z])(?:(?<!\p{{L}})(?:{_NAME}|{_TITLE})[ -]|[a-fA-F]{{32}}|(?<![0-9A-Za-z])(?:AKIA|gh[pousr]_|sk-)|{any_of(SAYS_NAME)} \p{{Lu}}|[{HAN_SURNAMES}])"
)
#: Draws after which a surrogate gives up its form for a tag that is distinct by its hash.
MOST_DRAWS = 8


def _luhn(value: Column) -> Column:
    """The Luhn sum of the digits of value, modulo 10."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    at = F.sequence(F.lit(1), F.length(digits))

    def weight(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(at, weight), F.lit(0), lambda a, x: a + x) % 10


def kind_of(value: Column) -> Column:
    """The kind of a string that PATTERN has found; null for digits that are no card."""
    first = {"email": F.contains(value, F.lit("@"))}
    shapes = {
        "hex": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$",
        "key": r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+)$",
        "iban": r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2}[A-Z0-9 ]*$",
        "ip6": r"^[0-9A-Fa-f]{3,4}:[0-9A-Fa-f:]*:[0-9A-Fa-f]{1,4}$",
        "han": r"^\p{IsHan}{2,3}$",
        "ip": r"^\d{1,3}(?:\.\d{1,3}){3}$",
        "ssn": r"^\d{3}-\d{2}-\d{4}$",
    }
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    out = F.when(first["email"], "email")
    for kind, shape in shapes.items():
        out = out.when(value.rlike(shape), kind)
    out = out.when(value.rlike(r"^\d[\d -]{11,}\d$") & (digits >= 13), F.when(_luhn(value) == 0, "card"))
    out = out.when(value.rlike(r"^[+(]?\d[\d ()./-]+\d$"), "phone")
    return out.when(value.rlike(r"^[\p{L}.'’\- ]+$") & value.contains(" "), "person").otherwise("secret")


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def given_names(key: str) -> dict[str, str]:
    """Each given name's replacement: a keyed turn of its list, so none stays and no two meet."""
    from hashlib import sha256

    out = {}
    for group, names in GIVEN.items():
        order = sorted(names, key=lambda n: sha256(f"{key}|{group}|{n}".encode()).digest())
        for a, b in zip(order, order[1:] + order[:1]):
            out |= {a: b, a.upper(): b.upper()}
    return out


def _formatted(value: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """value with each digit and ASCII letter drawn anew from digest."""
    digits = F.translate(digest, "abcdef", "358146")
    letters = F.translate(digest, "0123456789abcdef", "bcdfghjklmnpqrst")

    def draw(c: Column, i: Column) -> Column:
        at = F.pmod((i + 1) * 7, F.lit(64)) + 1
        if hexadecimal:
            return F.when(c == ":", c).otherwise(F.substr(digest, at, F.lit(1)))
        letter = F.substr(letters, at, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, at, F.lit(1))).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    #: By characters and not by places, as looking up a place takes as long as it is far into the value.
    drawn = F.array_join(F.transform(F.split(value, ""), draw), "")
    return F.when(value.rlike("[A-F]"), F.upper(drawn)).otherwise(drawn) if hexadecimal else drawn


def _iban(value: Column, plain: Column) -> Column:
    """plain, with the country of value and the check digits that belong to it."""
    body = F.substr(plain, F.lit(5))
    moved = F.split(F.regexp_replace(F.concat(body, F.substring(value, 1, 2), F.lit("00")), " ", ""), "")

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).when(c.rlike("[A-Z]"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc)

    check = F.lpad((98 - F.aggregate(moved, F.lit(0), step)).cast("string"), 2, "0")
    return F.concat(F.substring(value, 1, 2), check, body)


def _ip(value: Column, digest: Column) -> Column:
    """An address; those of private, local and loopback nets stay in theirs."""
    kept = F.regexp_extract(value, r"^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\.", 0)
    parts = [(_byte(digest, 0) % 100 + 11).cast("string"), *(_byte(digest, k).cast("string") for k in (1, 2, 3))]
    dots = F.length(F.regexp_replace(kept, "[^.]", ""))
    return F.concat(kept, F.array_join(F.slice(F.array(*parts), dots + 1, 4 - dots), "."))


def _han(value: Column, digest: Column) -> Column:
    surnames, given = (F.array(*map(F.lit, x)) for x in (HAN_SURNAMES, HAN_GIVEN))
    first = F.element_at(surnames, _byte(digest, 0) % len(HAN_SURNAMES) + 1)
    second, third = (F.element_at(given, _byte(digest, k) % len(HAN_GIVEN) + 1) for k in (1, 2))
    return F.concat(first, second, F.when(F.length(value) > 2, third).otherwise(""))


def _byte(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")


def _surname(value: Column, digest: Column) -> Column:
    """A surname in lower case, with the script, the gender of the ending and the hyphen of value."""
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def drawn(name: str, first: int) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[name]))
        parts = [F.element_at(syllables, _byte(digest, first + k) % len(SYLLABLES[name]) + 1) for k in range(4)]
        female, male = ENDINGS[name]
        ending = F.when(value.rlike("(?i)(?:а|я|ου|α|η)$"), female).otherwise(male)
        return F.concat(*parts[:3], F.when(_byte(digest, first + 4) % 2 == 0, parts[3]).otherwise(""), ending)

    def both(name: str) -> Column:
        return F.concat(drawn(name, 0), F.when(value.contains("-"), F.concat(F.lit("-"), drawn(name, 8))).otherwise(""))

    return F.when(script == "cyrillic", both("cyrillic")).when(script == "greek", both("greek")).otherwise(both("latin"))


def _cased(word: Column, like: Column) -> Column:
    """A lower-case surname in the case of another: all capitals or title case."""
    title = F.transform(F.split(word, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.when((F.length(like) > 1) & (F.upper(like) == like), F.upper(word)).otherwise(F.array_join(title, "-"))


def surrogate(kind: Column, value: Column, digest: Column) -> Column:
    """The replacement of an entity by the hex digest of its key, kind, value and draw."""
    plain = _formatted(value, digest)
    local, label = F.substring_index(value, "@", 1), F.regexp_extract(value, r"@([^.]+)", 1)
    domain = F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _byte(digest, 31) % 3 + 1)
    email = F.concat(_formatted(local, digest), F.lit("@"), _formatted(label, F.reverse(digest)), F.lit(".example."), domain)
    rest = lambda head: F.concat(head, F.substr(plain, F.length(head) + 1))
    card = F.concat(F.substring(value, 1, 1), F.substr(plain, F.lit(2), F.length(value) - 2))
    card = F.concat(card, ((10 - _luhn(F.concat(card, F.lit("0")))) % 10).cast("string"))
    return (
        F.when(kind == "email", email)
        .when(kind == "hex", _formatted(value, digest, hexadecimal=True))
        .when(kind == "key", rest(F.regexp_extract(value, "^(?:AKIA|gh[pousr]_|sk-)", 0)))
        .when(kind == "iban", _iban(value, plain))
        .when(kind == "ip6", _formatted(value, digest, hexadecimal=True))
        .when(kind == "han", _han(value, digest))
        .when(kind == "phone", rest(F.regexp_extract(value, r"^(?:\+\d(?!\d\d\d)\d{0,2}|\(|0)?", 0)))
        .when(kind == "card", card)
        .when(kind == "ip", _ip(value, digest))
        .when(kind == "surname", _surname(value, digest))
        .otherwise(plain)
    )


def surrogates(entities: DataFrame, key: str, most_draws: int = MOST_DRAWS) -> DataFrame:
    """(kind, token, surrogate) for each of the distinct entities (kind, token).

    A draw collides if its result is the surrogate of another entity with a
    smaller digest, or any entity's own string; then the next draw is taken. After most_draws the surrogate is a tag with the hash of the
    entity, so distinctness never fails for want of room.
    """
    drawn = checkpointed(entities.select("kind", "token", F.lit(0).alias("draw")))
    while True:
        digest = F.sha2(F.concat_ws("|", F.lit(key), "kind", "token", F.col("draw").cast("string")), 256)
        tag = F.concat(F.lit("<"), F.col("kind"), F.lit("-"), F.substring("digest", 1, 32), F.lit(">"))
        named = drawn.withColumn("digest", digest).withColumn(
            "surrogate", F.when(F.col("draw") >= most_draws, tag).otherwise(surrogate(F.col("kind"), F.col("token"), F.col("digest")))
        )
        named = checkpointed(named)
        turn = F.row_number().over(Window.partitionBy("surrogate").orderBy("draw", "digest"))
        own = entities.select(F.col("token").alias("surrogate"), F.lit(True).alias("taken")).distinct()
        judged = named.withColumn("turn", turn).join(own, "surrogate", "left")
        judged = judged.withColumn("again", ((F.col("turn") > 1) | F.col("taken").isNotNull()) & (F.col("draw") < most_draws))
        if judged.filter("again").isEmpty():
            return named.select("kind", "token", "surrogate")
        drawn = checkpointed(judged.select("kind", "token", (F.col("draw") + F.col("again").cast("int")).alias("draw")))


def _found(text: Column) -> Column:
    """All that PATTERN finds in a text, in order; null where HINT rules it out."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def _is_entity(value: Column) -> Column:
    return kind_of(value).isNotNull()


def _parts(value: Column) -> Column:
    """Tokens (kind, token) that need a surrogate: an entity itself, or the surnames of a person."""
    kind = kind_of(value)
    known = F.array(*(F.lit(x) for x in [*TITLES, *PARTICLES, *(n for names in GIVEN.values() for m in names for n in (m, m.upper()))]))
    listed = lambda t: F.forall(F.split(t, "-"), lambda p: F.array_contains(known, p))
    names = F.filter(F.split(value, " "), lambda t: ~F.array_contains(known, t) & ~listed(t) & ~t.rlike(r"^\p{Lu}\.$"))
    one = F.array(F.struct(kind.alias("kind"), value.alias("token")))
    return F.when(kind == "person", F.transform(names, lambda t: F.struct(F.lit("surname").alias("kind"), F.lower(t).alias("token")))).otherwise(one)


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the entities of its text replaced, and a column n_entities (long).

    key: the secret that draws depend on; the same key gives the same surrogates.
    Names found with a surname or a title are also replaced where one of their
    words stands alone in the same text. Null and empty texts stay as they are
    with 0 entities; equal texts get equal results; every row stays, in no order.
    A column n_entities of docs is replaced, all others are kept, and no column
    but the text is looked at. Digits that fail the Luhn check aren't cards.
    """
    kept = [c for c in docs.columns if c.lower() != "n_entities"]
    at = {n: fresh(f"_{n}", docs) for n in "entities key map spans spoken pieces new".split()}
    marked = docs.select(*kept, F.filter(_found(F.col(text_col)), _is_entity).alias(at["entities"]))
    none = F.coalesce(F.size(at["entities"]), F.lit(0)) <= 0
    clean = marked.filter(none).select(*kept, F.lit(0).cast("long").alias("n_entities"))
    some = docs.select(*kept).filter(F.coalesce(F.exists(_found(F.col(text_col)), _is_entity), F.lit(False)))
    some = some.withColumn(at["key"], F.md5(text_col))
    tokens = F.array_distinct(F.flatten(F.transform(F.filter(_found(F.col(text_col)), _is_entity), _parts)))
    held = some.select(at["key"], F.explode(tokens).alias("t")).select(at["key"], "t.kind", "t.token")
    held = checkpointed(held.distinct())
    named = surrogates(held.select("kind", "token").distinct(), key)
    pairs = held.join(named, ["kind", "token"]).groupBy(at["key"]).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "token"), "surrogate")))).alias(at["map"])
    )
    given = given_names(key)
    names, stays = _literal_map(given), F.array(*map(F.lit, [*TITLES, *PARTICLES]))

    def word(t: Column) -> Column:
        joined = F.transform(F.split(t, "-"), lambda p: F.try_element_at(names, p))
        compound = F.when(t.contains("-") & F.forall(joined, lambda p: p.isNotNull()), F.array_join(joined, "-"))
        return F.coalesce(F.try_element_at(names, t), compound, _cased(F.try_element_at(F.col(at["map"]), F.concat(F.lit("surname:"), F.lower(t))), t), t)

    def replaced(v: Column) -> Column:
        kind = kind_of(v)
        person = F.array_join(F.transform(F.split(v, " "), word), " ")
        other = F.coalesce(F.try_element_at(F.col(at["map"]), F.concat(kind, F.lit(":"), v)), v)
        return F.when(kind == "person", person).otherwise(other)

    spoken = F.filter(F.flatten(F.transform(F.filter(F.col(at["spans"]), lambda v: kind_of(v) == "person"), lambda v: F.split(v, " "))), lambda t: (F.length(t) > 2) & ~F.array_contains(stays, t))
    pieces = F.split(F.col(text_col), PATTERN, -1)
    boundary = r"(?<!\p{L})(?=\p{L})|(?<=\p{L})(?!\p{L})"
    alone = F.transform(
        pieces, lambda p: F.array_join(F.transform(F.split(p, boundary, -1), lambda t: F.when(F.array_contains(F.col(at["spoken"]), t), word(t)).otherwise(t)), "")
    )
    done = (
        some.join(pairs, at["key"], "left")
        .withColumn(at["spans"], F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0)))
        .withColumn(at["spoken"], spoken)
        .withColumn("n_entities", F.size(F.filter(at["spans"], _is_entity)).cast("long"))
        .withColumn(at["pieces"], F.when(F.size(at["spoken"]) > 0, alone).otherwise(pieces))
        .withColumn(at["new"], F.concat(F.transform(at["spans"], replaced), F.array(F.lit(""))))
        .withColumn(text_col, F.array_join(F.zip_with(at["pieces"], at["new"], lambda a, b: F.concat(a, b)), ""))
    )
    return clean.unionByName(done.select(*kept, "n_entities"))
