"""Surrogates for personal data and secrets.

One pattern finds the entities of a text in order; each is cut into literal
pieces and valued pieces (a title stays, a name's words are values; ``password=``
or ``"token": "`` stays, what follows is a value). Every distinct value gets a surrogate from a
keyed digest: same type, script, letter case and separators, a given name of the
gender its title tells, a card number with the same check sum. Equal values get
equal surrogates everywhere (phone and card numbers also across separators, names,
addresses and hexadecimal keys across letter case), so coreference holds. Collision checks make surrogates distinct: a value whose
surrogate another value has, or that is itself a value in the corpus, draws again
with the next attempt until none is left.

Texts without entities never leave their partition; a text with entities meets
its surrogates in a join on its id and hash.

Defined cases: a null text stays null and has no entities; an empty text stays
empty; repeated rows are replaced alike; a null ``doc_id`` is a value like any
other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize

# Entity patterns in order of precedence, and titles by gender.
TITLES = {"m": ["Mr", "Monsieur", "Herr", "Señor", "Господин"], "f": ["Mrs", "Ms", "Miss", "Madame", "Mademoiselle", "Frau", "Señora", "Señorita", "Госпожа"],
          "n": ["Dr", "Prof"]}
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
HEX = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
NAME = rf"(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"
# A group of a phone number never begins another entity; a further one, after a blank, is no decimal and no word either.
# A number of country 1 is complete with 10 digits, any other has 15 at most.
GROUP = rf"(?![ .-](?:{EMAIL}|{HEX}|{CARD}(?![ -]?[0-9]{{4}}(?![0-9]))|{IP}))[ .-]?[0-9]{{2,4}}"
FURTHER = rf"(?! [0-9]+(?:\.[0-9]|[A-Za-z_@])){GROUP}"
DONE = rf"(?![0-9])(?<!{'[0-9][ .()-]{0,2}' * 15}[0-9])"
PHONE = (r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
         rf"|\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{2,4}}\)?(?:{GROUP}(?:{FURTHER}){{1,2}}{DONE}|(?:{GROUP}){{2}}(?:{FURTHER})?{DONE})"
         r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])")
# A secret is what follows its name, "=" or ":" and perhaps a quote; a value that is itself an entity is left to that pattern.
ASSIGN = r"""(?i:password|passwd|pwd|secret|api_key|token)["']?+[ \t]*+[=:]{1,3}+>?+[ \t]*+"""
_OTHER = f"(?:{EMAIL}|{KEY}|{HEX}|{PHONE}|{CARD}|{IP}|{NAME})"
_QUOTED = "|".join(rf"{q}(?!{q}|{_OTHER}{q})[^\r\n]{{1,512}}?(?<!\\){q}" for q in "\"'")
SECRET = rf"""{ASSIGN}(?:{_QUOTED}|["']?+(?!{_OTHER}[.,;:!?)\]]*(?:[\s"']|$))[^\s"']+)"""
PATTERNS = {"email": EMAIL, "secret": SECRET, "key": KEY, "hex": HEX, "phone": PHONE, "card": CARD, "ip": IP, "name": NAME}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Every entity but a name holds one of these; most texts have none and skip the patterns.
MARKS = "[0-9@=:]|AKIA|[A-Fa-f]{32}"
# Given names by gender and script, and syllables of family names by script.
GIVEN = {
    "m_latin": ["Adam", "Brian", "Carl", "David", "Erik", "Felix", "George", "Henry", "Ivan", "James", "Karl", "Louis"],
    "f_latin": ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Grace", "Helen", "Irene", "Julia", "Laura", "Maria"],
    "n_latin": ["Alex", "Charlie", "Dana", "Jamie", "Kim", "Robin", "Sam", "Sasha"],
    "m_cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Павел"],
    "f_cyrillic": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Софья"],
    "n_cyrillic": ["Женя", "Саша", "Слава", "Шура"],
}
SYLLABLES = {"latin": ["bal", "cor", "den", "fal", "gar", "hol", "kel", "lin", "mar", "nor", "per", "ros", "sel", "tan", "ver", "wil"],
             "cyrillic": ["бал", "вер", "гор", "дан", "зор", "кар", "лин", "мир", "нов", "пал", "рос", "сол", "тан", "фед", "хар", "чер"]}
CYRILLIC = r"\p{IsCyrillic}"


def parts(match: Column) -> Column:
    """Pieces of an entity, in order: ``type`` ('' for literal text) and ``value``."""
    piece = lambda kind, value: F.struct(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), value.alias("value"))
    script = F.when(match.rlike(CYRILLIC), "_cyrillic").otherwise("_latin")
    title = F.regexp_extract(match, rf"^(?:{_TITLE})\.? ", 0)
    gender = F.when(title.rlike(rf"^(?:{'|'.join(TITLES['m'])})\.? "), "m").when(title.rlike(rf"^(?:{'|'.join(TITLES['f'])})\.? "), "f").otherwise("n")
    words = F.split(F.substr(match, F.length(title) + 1), " ")
    family = piece(F.concat(F.lit("family"), script), F.element_at(words, -1))
    given = F.array(piece("", title), piece(F.concat(F.lit("given_"), gender, script), words[0]), piece("", F.lit(" ")), family)
    lead = F.regexp_extract(match, f"""^{ASSIGN}["']?+""", 0)
    # a quoted value ends before the quote that it began with
    close = F.when(lead.rlike("[\"']$") & (F.substr(lead, F.lit(-1)) == F.substr(match, F.lit(-1))), F.substr(match, F.lit(-1))).otherwise("")
    value = F.substr(match, F.length(lead) + 1, F.length(match) - F.length(lead) - F.length(close))
    secret = F.array(piece("", lead), piece("secret", value), piece("", close))
    out = F.when(match.rlike(f"^(?:{PATTERNS['email']})$"), F.array(piece("email", match)))
    for kind in ("secret", "key", "hex", "phone", "card", "ip"):
        out = out.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), secret if kind == "secret" else F.array(piece(kind, match)))
    return out.otherwise(F.when(F.size(words) > 1, given).otherwise(F.array(piece("", title), family)))


def identity(kind: Column, value: Column) -> Column:
    """What two spellings of one value share."""
    any_case = kind.isin("email", "hex") | kind.startswith("family") | kind.startswith("given")
    return F.when(kind.isin("phone", "card"), F.regexp_replace(value, "[^0-9]+", "")).when(any_case, F.lower(value)).otherwise(value)


def digest(secret: str, kind: Column, ident: Column, attempt: int) -> Column:
    """128 hex digits from the key, the type and the value."""
    seed = F.concat_ws("|", F.lit(secret), kind, F.lit(str(attempt)), ident)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|more")), 256))


def _draw(hexes: Column, i: Column, n) -> Column:
    """A number below ``n`` from the two hex digits at place ``i`` (wrapping around)."""
    return (F.conv(F.substr(hexes, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int") % n)


def _letters(value: Column, hexes: Column, keep: int = 0, hexadecimal: bool = False) -> Column:
    """Digits to digits, letters to letters of the same case; the first ``keep`` alphanumerics and all else stay."""
    pick = lambda letters, i: F.substr(F.lit(letters), _draw(hexes, i, len(letters)) + 1, F.lit(1))
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def swap(c: Column, i: Column) -> Column:
        # a character's place counts alphanumerics only, so separators do not matter
        at = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^0-9A-Za-z]+", ""))
        if hexadecimal:
            upper = c.rlike("[A-F]") | (value.rlike("[A-F]") & ~value.rlike("[a-f]"))
            return let(pick("0123456789abcdef", at), lambda h: F.when(upper, F.upper(h)).otherwise(h))
        return F.when(~c.rlike("[0-9A-Za-z]") | (at < keep), c).when(c.rlike("[0-9]"), pick("0123456789", at)) \
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", at)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", at))
    return F.array_join(F.transform(chars, swap), "")


def _secret(value: Column, hexes: Column, attempt: Column) -> Column:
    """Letters and digits as in ``_letters``, other scripts too; nothing else stays if the value has none. Longer at each attempt."""
    plain = F.regexp_replace(F.regexp_replace(value, r"[^\x00-\x7F&&\p{Lu}]", "A"), r"[^\x00-\x7F]", "a")
    plain = F.when(plain.rlike("[0-9A-Za-z]"), plain).otherwise(F.regexp_replace(plain, "(?s).", "a"))
    return F.concat(_letters(plain, hexes), F.substr(hexes, F.lit(101), attempt))


def _luhn(number: Column) -> Column:
    """Luhn sum of the digits of a number, modulo 10."""
    digits = F.reverse(F.filter(F.split(number, ""), lambda c: c.rlike("[0-9]")))
    return F.aggregate(F.transform(digits, lambda c, i: let(c.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))),
                       F.lit(0), lambda a, x: (a + x) % 10)


def _card(value: Column, hexes: Column) -> Column:
    """A number that keeps its first digit and, through its last one, its Luhn sum."""
    drawn = _letters(value, hexes, keep=1)
    return let(drawn, lambda d: F.concat(F.substr(d, F.lit(1), F.length(d) - 1), F.pmod(
        F.substr(d, F.length(d)).cast("int") + _luhn(value) - _luhn(d), F.lit(10)).cast("string")))


def _capital(word: Column, like: Column) -> Column:
    shown = F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.substr(word, F.lit(2)))
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(word)).otherwise(shown)


def surrogate(kind: Column, value: Column, hexes: Column, attempt: Column) -> Column:
    """The replacement of a value under its digest."""
    def family(script: str) -> Column:
        n = F.greatest(F.lit(3), F.lit(2) + attempt)  # longer names at each attempt: they never run out
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(
            F.array(*map(F.lit, SYLLABLES[script])), _draw(hexes, i, len(SYLLABLES[script])) + 1)), "")

    def given(group: str) -> Column:
        base = F.element_at(F.array(*map(F.lit, GIVEN[group])), _draw(hexes, F.lit(0), len(GIVEN[group])) + 1)
        script = group[2:]
        more = F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.element_at(
            F.array(*map(F.lit, SYLLABLES[script])), _draw(hexes, i, len(SYLLABLES[script])) + 1))
        return F.when(attempt == 0, base).otherwise(F.concat(base, F.lit("-"), F.initcap(F.array_join(more, ""))))

    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    tld = F.lower(F.substring_index(domain, ".", -1))
    email = F.concat(_letters(local, hexes), F.lit("@"), F.substr(hexes, F.lit(101), F.lit(6) + attempt), F.lit(".example."),
                     F.when(tld.isin("com", "net", "org"), tld).otherwise(F.lit("com")))
    octets = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.when(i == 0, 1 + _draw(hexes, i, 223)).otherwise(_draw(hexes, i, 256)).cast("string"))
    out = F.when(kind == "email", email).when(kind == "card", _card(value, hexes)).when(kind == "phone", _letters(value, hexes, keep=1)) \
        .when(kind == "ip", F.array_join(octets, ".")).when(kind == "key", _letters(value, hexes, keep=4)) \
        .when(kind == "hex", _letters(value, hexes, hexadecimal=True)).when(kind == "secret", _secret(value, hexes, attempt))
    for script in SYLLABLES:
        out = out.when(kind == f"family_{script}", _capital(family(script), value))
    for group in GIVEN:
        out = out.when(kind == f"given_{group}", _capital(given(group), value))
    return out


def assign(values: DataFrame, secret: str) -> DataFrame:
    """``type, ident, digest, attempt`` for distinct ``type, ident``, with distinct surrogates."""
    values = materialize(values.select("type", "ident").distinct(), "idents")
    pending, done, attempt = values, None, 0
    while True:
        c = pending.select("type", "ident", digest(secret, F.col("type"), F.col("ident"), attempt).alias("digest"), F.lit(attempt).alias("attempt"))
        c = c.withColumn("shown", surrogate(F.col("type"), F.col("ident"), F.col("digest"), F.col("attempt")))
        seen = identity(F.col("type"), F.col("shown"))
        first = F.row_number().over(Window.partitionBy("type", "shown").orderBy("ident")) == 1
        c = c.withColumn("shown", seen).withColumn("ok", first)
        taken = values.select(F.col("type").alias("_t"), F.col("ident").alias("_s"))
        if done is not None:
            taken = taken.unionByName(done.select(F.col("type").alias("_t"), F.col("shown").alias("_s"))).distinct()
        c = c.join(taken.withColumn("_taken", F.lit(True)), (F.col("type") == F.col("_t")) & (F.col("shown") == F.col("_s")), "left")
        c = materialize(c.withColumn("ok", F.col("ok") & F.col("_taken").isNull()).drop("_t", "_s", "_taken"), "drawn")
        good = c.where("ok").drop("ok")
        done = good if done is None else done.unionByName(good)
        pending = c.where(~F.col("ok")).select("type", "ident")
        attempt += 1
        if pending.isEmpty():
            return done.drop("shown")


def replace_pii(docs: DataFrame, secret: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_entities, text`` with every entity replaced."""
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    has = (F.col("text").rlike(MARKS) & F.col("text").rlike(ANY)) | F.col("text").rlike(PATTERNS["name"])
    dirty = d.where(has).withColumn("h", F.xxhash64("text"))
    found = dirty.select("doc_id", "h", F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), parts).alias("p"))
    found = materialize(found.dropDuplicates(["doc_id", "h"]), "entities")
    rows = found.select("doc_id", "h", F.posexplode("p").alias("i", "m")).select("doc_id", "h", "i", F.posexplode("m").alias("j", "x")) \
        .select("doc_id", "h", "i", "j", "x.type", "x.value")
    values = rows.where("type <> ''").select("type", "value").distinct().withColumn("ident", identity(F.col("type"), F.col("value")))
    values = materialize(values, "values")
    shown = values.join(assign(values, secret), ["type", "ident"]) \
        .select(F.col("type").alias("_t"), F.col("value").alias("_v"),
                surrogate(F.col("type"), F.col("value"), F.col("digest"), F.col("attempt")).alias("shown"))
    shown = materialize(shown, "surrogates")
    rows = rows.join(shown, (F.col("type") == F.col("_t")) & (F.col("value") == F.col("_v")), "left")
    per_doc = rows.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("i", "j", F.coalesce("shown", "value").alias("s")))).alias("r")) \
        .withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    # literal text between entities, with the pieces of entity i behind part i
    between = F.split("text", ANY, -1)
    fill = F.transform("r", lambda x, n: F.concat(F.when(x["j"] == 0, F.get(F.col("between"), x["i"])).otherwise(F.lit("")), x["s"]))
    out = dirty.join(per_doc, dirty["doc_id"].eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))) \
        .withColumn("between", between) \
        .select("doc_id", F.size(F.filter("r", lambda x: x["j"] == 0)).cast("long").alias("n_entities"),
                F.concat(F.array_join(fill, ""), F.element_at("between", -1)).alias("text"))
    return d.where(~F.coalesce(has, F.lit(False))).select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text").unionByName(out)
