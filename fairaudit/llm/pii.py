"""Surrogates for personal data: keyed, type-consistent replacements.

Entities are found by one pattern; each has a canonical form (digits of a phone
number, lower case of an address), and the surrogate is a function of type, key
and canonical form alone. So the same person or number gets the same surrogate
in every document, without a join:

- phone numbers, cards, social security numbers and IP addresses go through a
  keyed Feistel network on their digits (a bijection, so different originals
  stay different); separators stay where they were, a card keeps its first
  digit and whether its check digit is right;
- e-mail addresses, names and secrets are built from a keyed hash: same case,
  same length for secrets, same title, gender and script for names.

The collision check covers the whole corpus: a surrogate may equal neither a
real entity nor another entity's surrogate. Entities that break this draw again
with the next attempt number, against everything taken so far. Only these few
redrawn entities are joined back to documents; the planner broadcasts that table
only if it is under its size threshold. Everything is DataFrame code.

Drawing goes on until no entity collides; names and addresses get longer with each
attempt. Where all numbers of a digit type are in use, an entity keeps its first
surrogate, which is distinct from all other surrogates of the digit types.

Defined results: a null text stays null, an empty one empty; both have 0 entities.
Null ids are matched null-safely. Repeated rows get equal results. Texts are read
whole. An empty table gives an empty result. A person found by a form of address is
replaced wherever the text repeats the name or its last word, and "Mr Smith" is the
one person of the text whose longer name ends with Smith, if there is just one. An
input column ``n_entities`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .columns import aside, back
from .registry import read_table, register

KEY = "surrogate-key-1"      # for trials; a job with real data names its own
KEY_CONF = "spark.fairaudit.surrogateKey"
LOOK = 8                     # redraws between two looks for spaces without a free number
ROUNDS = 8

# Forms of address by gender; names and syllables by gender and script.
TITLES_M = ("Mr", "MR", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "г-н", "Κύριος")
TITLES_N = ("Dr", "DR", "Prof", "Professor", "Doctor", "Доктор")      # say nothing of gender
TITLES_F = ("Mrs", "MRS", "Ms", "MS", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "г-жа", "Κυρία")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Nils", "Oscar", "Paul", "Simon", "Victor"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Ida", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Sara", "Vera"),
    ("greek", "m"): ("Ανδρέας", "Βασίλης", "Γιώργος", "Δημήτρης", "Ευάγγελος", "Θωμάς", "Ιωάννης", "Κώστας", "Λουκάς", "Μάριος", "Νίκος", "Πέτρος", "Σπύρος", "Στέφανος", "Φώτης", "Χρήστος"),
    ("greek", "f"): ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ειρήνη", "Ζωή", "Ελένη", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νίκη", "Όλγα", "Σοφία", "Φωτεινή", "Χριστίνα"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Тимур", "Юрий"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Юлия"),
}
SYLLABLES = {
    "greek": ("βα", "δε", "φι", "γο", "χυ", "κα", "λε", "μι", "νο", "που", "ρα", "σε", "τι", "βο", "ζου", "λαν"),
    "latin": ("ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "zu", "lan"),
    "cyrillic": ("ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "зу", "лан"),
}
DOMAINS = ("example.org", "example.net", "example.com")

_TITLE = "(?:" + "|".join(TITLES_M + TITLES_F + TITLES_N) + r")\.?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’\-]+"
PATTERN = "|".join((
    r"[\p{L}\p{N}][\p{L}\p{N}._%+\-]*@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    rf"(?<![\p{{L}}\p{{N}}]){_TITLE} {_NAME}(?: (?!{_TITLE} ){_NAME}){{0,2}}",
    r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-fA-F]{32,})(?![\p{L}\p{N}])",
    rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    r"(?<![\d.\-])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7})(?!\d)",
    r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)",
    r"(?:\(\d{3}\) ?|(?<![\d\-])\d{3}[.\-])\d{3}[.\-]\d{4}(?![\d\-])",
))
# a text without any of these holds no entity; saves the costly pattern for most texts
_HINT = rf"[0-9@]|{_TITLE} \p{{Lu}}|sk-|gh[pousr]_|AKIA|[a-fA-F]{{32}}"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def kind_of(v: Column) -> Column:
    """Type of a matched entity, from its shape."""
    return (F.when(v.contains("@"), "email")
            .when(v.rlike(rf"^{_TITLE} "), "person")
            .when(v.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "ip")
            .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(v.rlike(r"^(\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})$"), "card")
            .when(v.rlike(r"^[+(]|^\d{3}[.\-]\d{3}[.\-]\d{4}$"), "phone")
            .otherwise("secret"))


def _gender(v: Column) -> Column:
    title = F.regexp_extract(v, rf"^({_TITLE}) ", 1)
    plain = F.regexp_replace(title, r"\.$", "")
    return F.when(plain.isin(*TITLES_F), "f").when(plain.isin(*TITLES_N), "n").otherwise("m")


def _name(v: Column) -> Column:
    return F.regexp_replace(v, rf"^{_TITLE} ", "")


def canon_of(kind: Column, v: Column) -> Column:
    """The form under which mentions of one entity are equal."""
    return (F.when(kind.isin("phone", "card", "ssn"), _digits(v))
            .when(kind == "person", F.concat(_gender(v), F.lit(" "), F.lower(_name(v))))
            .when(kind == "ip", v).otherwise(F.lower(v)))


def _hash(key: str, *cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[c.cast("string") for c in cols]), 256)


def _hash_int(key: str, *cols: Column) -> Column:
    return F.conv(F.substring(_hash(key, *cols), 1, 12), 16, 10).cast("long")


def _feistel(key: str, tag: Column, a: Column, b: Column, ma: Column, mb: Column) -> Column:
    """Keyed permutation of pairs (a mod ma, b mod mb): each round adds a hash of
    one half to the other, so it can be undone."""
    def step(s: Column, i: Column) -> Column:
        na = F.when(i % 2 == 0, F.pmod(s["a"] + _hash_int(key, tag, i, s["b"]), ma)).otherwise(s["a"])
        nb = F.when(i % 2 == 1, F.pmod(s["b"] + _hash_int(key, tag, i, s["a"]), mb)).otherwise(s["b"])
        return F.struct(na.alias("a"), nb.alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _permute_digits(key: str, tag: Column, s: Column) -> Column:
    """Keyed permutation of the digit strings of one length (2 to 24 digits)."""
    left = F.floor(F.length(s) / 2).cast("int")
    right = (F.length(s) - left).cast("int")
    a, b = F.substr(s, F.lit(1), left), F.substr(s, left + 1, right)
    ten = F.lit(10).cast("double")
    p = _feistel(key, tag, a, b, F.pow(ten, left).cast("long"), F.pow(ten, right).cast("long"))
    return F.get(F.transform(F.array(p), lambda x: F.concat(
        F.lpad(x["a"].cast("string"), left, "0"), F.lpad(x["b"].cast("string"), right, "0"))), 0)


def _luhn_digit(body: Column) -> Column:
    """Check digit for the digits before it."""
    n = F.length(body)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(body, n - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)
    return F.pmod(10 - F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10, F.lit(10))


def _syllables(h: Column, script: str, start: int, n: int) -> Column:
    table = F.array(*[F.lit(x) for x in SYLLABLES[script]])
    parts = [F.get(table, F.conv(F.substr(h, F.lit(start + i), F.lit(1)), 16, 10).cast("int")) for i in range(n)]
    return F.concat(*parts)


def _given(h: Column, script: str, gender: str, start: int) -> Column:
    table = F.array(*[F.lit(x) for x in GIVEN[(script, gender)]])
    return F.get(table, F.conv(F.substr(h, F.lit(start), F.lit(1)), 16, 10).cast("int"))


def _further(h: Column, script: str, n: Column) -> Column:
    """``n`` syllables more (none for 0), so that the names to draw from never run out."""
    table = F.array(*[F.lit(x) for x in SYLLABLES[script]])
    some = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(table, F.conv(F.substr(h, F.pmod(i, F.lit(128)) + 1, F.lit(1)), 16, 10).cast("int")))
    return F.when(n > 0, F.concat_ws("", some)).otherwise(F.lit(""))


def candidate(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """Canonical form of the surrogate that ``attempt`` draws."""
    tag = F.concat_ws("|", kind, attempt.cast("string"))
    h = _hash(key, tag, canon)
    n = F.length(canon)
    keep = F.greatest(n - 10, F.lit(0))
    phone = F.concat(F.substr(canon, F.lit(1), keep), _permute_digits(key, tag, F.substr(canon, keep + 1, n - keep)))
    # card: the middle is permuted, the check digit keeps its distance to the right one
    old = F.substr(canon, F.lit(1), n - 1)
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _permute_digits(key, tag, F.substr(canon, F.lit(2), n - 2)))
    off = F.substr(canon, n, F.lit(1)).cast("int") - _luhn_digit(old)
    card = F.get(F.transform(F.array(body), lambda x: F.concat(x, F.pmod(_luhn_digit(x) + off, F.lit(10)).cast("string"))), 0)
    o = F.split(canon, r"\.")
    oct_ = [F.get(o, i).cast("long") for i in range(4)]
    pair = _feistel(key, tag, oct_[0] * 256 + oct_[1], oct_[2] * 256 + oct_[3], F.lit(65536), F.lit(65536))
    ip = F.get(F.transform(F.array(pair), lambda x: F.concat_ws(
        ".", F.floor(x["a"] / 256).cast("string"), (x["a"] % 256).cast("string"),
        F.floor(x["b"] / 256).cast("string"), (x["b"] % 256).cast("string"))), 0)
    long_hash = F.sha2(F.concat_ws("|", F.lit(key), tag, canon), 512)
    num = F.lpad((F.conv(F.substring(h, 41, 8), 16, 10).cast("long") % 10000).cast("string"), 4, "0")
    domain = F.get(F.array(*[F.lit(x) for x in DOMAINS]), (F.conv(F.substring(h, 49, 4), 16, 10).cast("long") % len(DOMAINS)).cast("int"))
    local = F.split(canon, "@")[0]
    email = F.concat(_syllables(h, "latin", 1, 3), F.when(local.contains("."), F.lit(".")).otherwise(F.lit("")),
                     _syllables(h, "latin", 5, 4), _further(long_hash, "latin", attempt), num, F.lit("@mail."), domain)
    prefix = F.regexp_extract(canon, r"^(akia|gh[pousr]_|sk-)", 1)
    secret = F.concat(prefix, F.rpad(long_hash, n - F.length(prefix), long_hash))
    cyr = canon.rlike(r"^. .*\p{IsCyrillic}")
    words = F.size(F.split(canon, " ")) - 1

    def person(script: str) -> Column:
        first = F.when(canon.startswith("f"), _given(h, script, "f", 30)).otherwise(_given(h, script, "m", 30))
        second = F.when(canon.startswith("f"), _given(h, script, "f", 31)).otherwise(_given(h, script, "m", 31))
        return F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.lower(F.concat_ws(
            " ", F.when(words > 1, first), F.when(words > 2, second), F.concat(_syllables(h, script, 1, 5), _further(long_hash, script, attempt)))))
    greek = canon.rlike(r"^. .*\p{IsGreek}")
    return (F.when(kind == "phone", phone).when(kind == "card", card)
            .when(kind == "ssn", _permute_digits(key, tag, canon)).when(kind == "ip", ip)
            .when(kind == "email", email).when(kind == "secret", secret)
            .otherwise(F.when(cyr, person("cyrillic")).when(greek, person("greek")).otherwise(person("latin"))))


def _short_name(v: Column, new: Column) -> Column:
    """A name for a mention: a short one ("Mr Smith" of John Smith) takes as many words
    of the whole name, from its end."""
    words = F.split(F.substring(new, 3, 200), " ")
    short = F.least(F.size(F.split(_name(v), " ")), F.size(words))
    return F.array_join(F.slice(words, F.size(words) - short + 1, short), " ")


def render(kind: Column, v: Column, new: Column, name: Column) -> Column:
    """The surrogate in the shape of the mention: separators, case, title."""
    chars = F.split(v, "")
    refill = F.concat_ws("", F.transform(
        F.filter(chars, lambda c: c != ""),
        lambda c, i: F.when(c.rlike(r"\d"), F.substr(new, F.length(_digits(F.substr(v, F.lit(1), i + 1))), F.lit(1))).otherwise(c)))
    upper = (v == F.upper(v)) & (v != F.lower(v))
    name = F.when(_name(v) == F.upper(_name(v)), F.upper(name)).otherwise(F.initcap(name))
    person = F.concat(F.regexp_extract(v, rf"^({_TITLE} )", 1), name)
    return (F.when(kind.isin("phone", "card", "ssn"), refill).when(kind == "person", person)
            .when(kind == "ip", new).when(upper, F.upper(new))
            .when(v.startswith("AKIA"), F.upper(new)).otherwise(new))


def _mentions(text: Column) -> Column:
    """Entities of a text in order, as structs of value, kind and canonical form."""
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    kinds = F.transform(found, lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), canon_of(x["kind"], x["v"]).alias("canon")))


def redraws(entities: DataFrame, key: str = KEY) -> DataFrame:
    """Entities whose first surrogate collides: ``kind, canon, attempt``.

    ``entities`` holds distinct ``kind, canon``. Attempts go on against all real
    entities and all surrogates taken so far until none collides. Names and
    addresses grow by a syllable with each attempt. Numbers keep their length; only
    where every number of it is real or taken does an entity keep its first one.
    """
    real = entities.select("kind", F.col("canon").alias("new"))
    drawn = staged(entities.withColumn("new", candidate(F.col("kind"), F.col("canon"), F.lit(0), key)), "pii-first")
    keeper = drawn.groupBy("kind", "new").agg(F.min("canon").alias("keep"))
    hits = drawn.join(real, ["kind", "new"], "left_semi").select("kind", "canon")
    twins = drawn.join(keeper, ["kind", "new"]).filter("canon <> keep").select("kind", "canon")
    todo = staged(hits.union(twins).distinct(), "pii-todo")
    taken = drawn.select("kind", "new")
    done = todo.select("kind", "canon", F.lit(0).alias("attempt")).limit(0)
    t = 0
    while not todo.isEmpty():
        t += 1
        c = todo.withColumn("new", candidate(F.col("kind"), F.col("canon"), F.lit(t), key))
        c = c.join(real.union(taken), ["kind", "new"], "left_anti")
        first = c.groupBy("kind", "new").agg(F.min("canon").alias("canon"))
        got = staged(first, "pii-redrawn")
        taken = taken.union(got.select("kind", "new"))
        done = done.union(got.select("kind", "canon", F.lit(t).alias("attempt")))
        left = todo.join(got, ["kind", "canon"], "left_anti")
        if t % LOOK == 0:
            taken, done = staged(taken, "pii-taken"), staged(done, "pii-done")
            left = _with_room(left, real.union(taken))
        todo = staged(left, "pii-todo")
    return staged(done, "pii-redraws")


def _space(kind: Column, number: Column) -> Column:
    """The numbers that can stand for each other: ``space`` and how many there are, null where they never run out."""
    n = F.length(number)
    keep = F.greatest(n - 10, F.lit(0))
    ten = F.lit(10).cast("double")
    return (F.when(kind == "phone", F.struct(F.concat_ws("|", kind, n.cast("string"), F.substr(number, F.lit(1), keep)).alias("space"), F.pow(ten, n - keep).alias("room")))
            .when(kind == "ssn", F.struct(kind.alias("space"), F.pow(ten, F.lit(9)).alias("room")))
            .when(kind == "ip", F.struct(kind.alias("space"), F.pow(F.lit(2.0), F.lit(32)).alias("room"))))


def _with_room(todo: DataFrame, used: DataFrame) -> DataFrame:
    """The entities of ``todo`` in whose space a number is free."""
    mine = todo.select("kind", "canon", _space(F.col("kind"), F.col("canon")).alias("s")).select("kind", "canon", "s.space", "s.room")
    per = (used.distinct().select(_space(F.col("kind"), F.col("new")).alias("s")).filter("s IS NOT NULL")
               .groupBy(F.col("s.space").alias("_space")).agg(F.count(F.lit(1)).alias("_used")))
    j = mine.join(per, F.col("space") == F.col("_space"), "left")
    return j.filter(F.col("room").isNull() | F.col("_used").isNull() | (F.col("_used") < F.col("room"))).select("kind", "canon")


def _resolved(canon: Column, persons: Column) -> Column:
    """The one longer name of the document that ends with this name, if there is just one."""
    longer = F.filter(persons, lambda p: (p != canon) & (F.substring(p, 1, 2) == F.substring(canon, 1, 2)) & p.endswith(F.concat(F.lit(" "), F.substring(canon, 3, 300))))
    return F.when(F.size(longer) == 1, F.get(longer, F.lit(0))).otherwise(canon)


def _with_people(d: DataFrame) -> DataFrame:
    """``_m`` and ``_parts`` of texts that hold persons: mentions without a form of
    address (the whole name, or its last word) of a person found in the text are
    entities too, and a short name stands for the one longer name that ends with it."""
    text, named = F.col("text"), F.filter("_m", lambda x: x["kind"] == "person")
    last = lambda full: F.element_at(F.split(full, " "), -1)
    d = d.withColumn("_people", F.array_distinct(F.transform(named, lambda x: F.struct(_name(x["v"]).alias("full"), x["canon"].alias("canon")))))
    d = d.withColumn("_canons", F.array_distinct(F.transform("_people", lambda p: p["canon"])))
    d = d.withColumn("_people", F.transform("_people", lambda p: F.struct(p["full"].alias("full"), _resolved(p["canon"], F.col("_canons")).alias("canon"))))
    d = d.withColumn("_names", F.array_distinct(F.flatten(F.transform("_people", lambda p: F.array(p["full"], last(p["full"]))))))
    d = d.withColumn("_names", F.array_sort("_names", lambda x, y: F.length(y) - F.length(x)))
    either = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:\Q"), F.array_join("_names", r"\E|\Q"), F.lit(r"\E)(?![\p{L}\p{N}])"))
    d = d.withColumn("_either", F.when(F.size("_people") > 0, either))

    def owner(v: Column) -> Column:
        whole = F.filter("_people", lambda p: p["full"] == v)
        return F.get(F.concat(whole, F.filter("_people", lambda p: last(p["full"]) == v)), F.lit(0))["canon"]

    # one step after the other, so that no expression is written into the next one many times
    again = F.transform(F.regexp_extract_all(text, F.col("_either"), F.lit(0)), lambda v: F.struct(
        v.alias("v"), F.when(F.array_contains("_names", v), F.lit("bare")).otherwise(kind_of(v)).alias("kind")))
    again = F.transform(again, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), canon_of(x["kind"], x["v"]).alias("canon")))
    again = F.transform(again, lambda x: F.struct(
        x["v"].alias("v"), F.when(x["kind"] == "bare", F.lit("person")).otherwise(x["kind"]).alias("kind"),
        F.when(x["kind"] == "bare", owner(x["v"])).when(x["kind"] == "person", _resolved(x["canon"], F.col("_canons")))
         .otherwise(x["canon"]).alias("canon")))
    people = F.col("_either").isNotNull()
    return (d.withColumn("_m", F.when(people, again).otherwise(F.col("_m")))
             .withColumn("_parts", F.when(people, F.split(text, F.col("_either"), -1)).when(F.size("_m") > 0, F.split(text, PATTERN, -1)))
             .drop("_people", "_canons", "_names", "_either"))


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """Documents with every entity replaced; adds ``n_entities``.

    The key is the caller's, else that of the setting ``KEY_CONF``, else ``KEY``. One
    scan collects the entities (distinct per document, then over all), one
    scan rewrites the texts. No text is shuffled unless the table of redrawn
    entities is over the planner's broadcast threshold.
    """
    key = key or docs.sparkSession.conf.get(KEY_CONF, KEY)
    d = aside(docs, "doc_id", "text")
    # the same value in many documents is merged before the shuffle of distinct()
    seen = staged(d.select("doc_id", F.explode(_mentions(F.col("text"))).alias("m"))
                  .select("doc_id", "m.kind", "m.canon").distinct(), "pii-seen")
    redrawn = redraws(staged(seen.select("kind", "canon").distinct(), "pii-entities"), key)
    again = seen.join(redrawn, ["kind", "canon"]).groupBy(F.col("doc_id").alias("_id")).agg(
        F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("_again"))
    d = d.join(staged(again, "pii-again"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    d = _with_people(d.withColumn("_m", _mentions(F.col("text"))))
    drawn = F.transform("_m", lambda m: F.struct(m["kind"].alias("kind"), m["v"].alias("v"), candidate(
        m["kind"], m["canon"], F.coalesce(F.element_at(F.col("_again"), F.concat_ws("|", m["kind"], m["canon"])), F.lit(0)), key).alias("new")))
    drawn = F.transform(drawn, lambda m: F.struct(m["kind"].alias("kind"), m["v"].alias("v"), m["new"].alias("new"), _short_name(m["v"], m["new"]).alias("name")))
    d = d.withColumn("_new", F.transform(drawn, lambda m: render(m["kind"], m["v"], m["new"], m["name"])))
    merged = F.concat_ws("", F.zip_with("_parts", "_new", lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))))
    d = d.withColumn("n_entities", F.when(F.size("_m") > 0, F.size("_m")).otherwise(0))
    text = F.when(F.col("n_entities") > 0, merged).otherwise(F.col("text"))
    own = [c for c in docs.columns if c != "n_entities"]
    return back(d, [*own, "n_entities"], text=text, n_entities=F.col("n_entities"))


@register("op3_pii_surrogates")
def op3_pii_surrogates(spark, sf_dir):
    return replace_pii(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
