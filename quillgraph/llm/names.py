"""Variant spellings of names typed by people.

An identity is read into a profile: a given name (or an initial), and the
spellings of the family name that the typed name and the mail address give.
Candidates come from suffix blocking: every suffix of a spelling from
``MIN_SUFFIX`` letters on, also of the spelling read backwards so that a slip
in the last letters doesn't hide it, is an index key together with the initial
of the given name.  A key that too many profiles share is refined by the whole
given name; where it is still too common then, only those of its profiles meet
that no longer suffix brings together, in blocks.  Pairs are compared by the
ratio of their longest common subsequence and their given names.  Entities are
the connected components of the links.

Which word is the given name is learned from the identities themselves: a given
name stands first beside many different words.  A name of two words of which
neither is known for one is read in both orders.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.session import cut

MIN_SUFFIX = 4
#: Profiles under one index key from which the key is refined, and met in blocks.
COMMON = 400
#: Different words that a word stands first beside, from which it is a given name.
GIVEN_PARTNERS = 3
#: How many times rarer than a given name a word must be to count as a slip of it, unless it is rarer than any name.
SLIP_RARITY = 10
#: Ratio of the longest common subsequence from which family names agree.
RATIO = 0.82

# Short forms of given names, each line one name and its forms.
NICKNAMES = """
alexander alex sasha sandy xander lex al aleksandr alexandre
anastasia nastya ana stacy stasia
anthony tony ant
benjamin ben benny benji
catherine cathy cat cate
charles charlie chuck chas
christopher chris kit topher
daniel dan danny dani
david dave davey davy
dmitri dima mitya dmitry dmitriy
edward ed eddie ted teddy ned
ekaterina katya katia kat
elizabeth beth liz lizzie betty eliza lisa libby betsy
francisco fran paco pancho cisco frank
frederick fred freddy fritz rick
gabriela gabi gaby gabriella
gregory greg
heinrich heinz
ivan vanya
james jim jimmy jamie
jennifer jen jenny jenn
jessica jess jessie
johannes hannes johan hans jo
john jack johnny jon
jonathan jonny nathan
jose pepe
joseph joe joey jos
katherine kate kathy katie kathryn kay
leonard leo len lenny
lucia lucy lu
margaret maggie meg peg peggy marge greta rita
maria mary masha
matthew matt matty
michael mike mick mikey misha
nicholas nick nicky nico klaus
nikolai kolya
olena lena olya olenka
patricia pat patty tricia trish
peter pete
philip phil
piotr piotrek
rebecca becca becky
richard dick richie ricky
robert bob rob bobby robbie bert
ronald ron ronnie
rosalind ros roz rosa
samuel sam sammy
sergei seryozha
stephen steve stevie steven
susan sue susie
theodore theo ted teddy
thomas tom tommy
timothy tim timmy
tobin toby tobi
umar omar
victoria vicky tori vic vicki
vladimir volodya vova
wanjiru shiru ciru
william will bill billy liam willy
xenia ksenia ksyusha
yusuf joe yousef yosef
zofia zosia sophie sofia
"""
_NAMES: dict[str, list[str]] = {}
for _line in NICKNAMES.strip().splitlines():
    for _form in _line.split():
        _NAMES.setdefault(_form, []).append(_line.split()[0])
# A full name stands for itself only; a form of several names for all of them, with slashes.
_CANON = {f: f if f in ns else "/".join(ns) for f, ns in _NAMES.items()}

# Fixed values.
_TITLES = frozenset("dr mr mrs ms prof professor sir dame ing dipl herr frau jr sr ii iii phd msc".split())
_ORG_WORDS = frozenset(
    "inc incorporated ltd limited llc gmbh corp corporation co company ag sa bv plc oy ab systems system research industries industry software "
    "labs laboratories technologies technology solutions group foundation authors contributors project team institute university media networks "
    "studios studio consulting services holding holdings partners res sof ind sys tech lab".split()
)
_ORG_SHORT = frozenset("res sof ind sys tech lab corp inc ltd co".split())
_ROLE_MAIL = re.compile(r"^(?:team|dev|devs|developers?|info|admin|administrator|support|oss|code|noreply|no-reply|build|ci|ops|mail|contact|hello|office|security|root|git|github|gitlab|list|lists|all|group|staff|bot)\d*(?:[-_.+].*)?$|bot\b")
_BOT = re.compile(r"\bbots?\b|\[bot\]|[-_]bot[-_\d]*$|^(?:ci|build|release|deploy|jenkins|travis|renovate|dependabot)(?:[-_].*)?$", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")
#: UTF-8 that was read as Latin-1.
_TWICE = re.compile(r"[\u00c2-\u00c5][\u0080-\u00bf]")
_FOLDED = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ı": "i", "þ": "th", "ð": "d"})


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower().translate(_FOLDED))
    return "".join(c for c in text if not unicodedata.combining(c))


def repaired(text: str) -> str:
    """Composed text, with UTF-8 that was read as Latin-1 read again."""
    if _TWICE.search(text):
        text = _TWICE.sub(lambda m: m.group().encode("latin-1").decode("utf-8", "replace"), text)
    return unicodedata.normalize("NFC", text)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows as bits of an integer."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def _given(word: str, known: dict[str, str]) -> str | None:
    """The given name a word stands for, through short forms, slips and what was learned, or None."""
    if word in _CANON:
        return _CANON[word]
    if word in known:
        return _CANON.get(known[word], known[word])
    if len(word) < 4:
        return None
    best = max(_CANON, key=lambda g: (lcs_ratio(word, g), g))
    return _CANON[best] if slip_of(word, best) else None


def slip_of(word: str, name: str) -> bool:
    """Whether a word is a mistyped given name."""
    return abs(len(name) - len(word)) <= 1 and min(len(name), len(word)) >= 4 and lcs_ratio(word, name) >= 0.83 - 0.08 * (len(name) <= 5)


def _mail_parts(email: str) -> tuple[list[str], str]:
    """The words of a mail address that may name a person, and its domain's first label."""
    local, _, domain = fold(email.strip()).partition("@")
    label = domain.split(".")[0]
    if re.match(r"^\d+\+", local):
        local = local.split("+", 1)[1]
    local = local.split("+")[0]
    if not local or _ROLE_MAIL.search(local):
        return [], label
    words = [w for w in re.split(r"[^a-z]+", local) if w]
    machine = re.match(r"^([a-z]{4,})-(?:laptop|desktop|pc|macbook|mbp|workstation|home|dev)\b", label)
    if machine:
        words.append(machine.group(1))
    return words, label


def _typed_words(author: str) -> tuple[str, list[str]]:
    """An author without what stands in brackets, and its words in lower case without accents and titles."""
    bare = re.sub(r"\([^)]*\)|\[[^\]]*\]|<[^>]*>|\"[^\"]*\"", " ", repaired(author))
    words = []
    for w in (w for w in re.split(r"[^\w']+|_", bare) if w):
        words += [w] if w.isupper() or w.islower() else _CAMEL.split(w)
    return bare, [w for w in ("".join(c for c in fold(x) if c.isalpha()) for x in words) if w and w not in _TITLES]


def _family_first(bare: str) -> bool:
    """Whether a name is typed so that its family name comes first: before a comma, or in capitals."""
    return "," in bare or bool(bare.split() and bare.split()[0].isupper() and len(bare.split()[0]) > 1 and not bare.isupper())


Reading = tuple[str, list[str]]


def profile(author: str, email: str | None, known: dict[str, str] | None = None) -> tuple[str, str, list[str], Reading | None]:
    """(kind, given name or initial, spellings of the family name, most trusted last, the reading in the other order or None).

    ``kind`` is 'person', 'org', 'bot' or '' where the name can't be read.
    ``known`` says which words are given names, and of which name each is a slip.
    """
    known = known or {}
    if _BOT.search(author):
        return "bot", "", [author], None
    bare, words = _typed_words(author)
    order_comma = "," in bare
    mail, label = _mail_parts(email or "")
    if not words:
        return "", "", [], None
    short = {fold(m) for m in re.findall(r"(\w+)\.", bare)}
    org = [w for w in words if w in _ORG_WORDS and (w not in _ORG_SHORT or w in short or len(words) > 1)]
    if org or (label and len(words) > 1 and len(label) > 5 and lcs_ratio(words[0], label) > 0.9 and not _given(words[0], known)):
        core = [w for w in words if w not in _ORG_WORDS and w != "the"]
        if core:
            return "org", "", ["".join(core)], None
    long = [w for w in words if len(w) > 1]
    initials = [w for w in words if len(w) == 1]

    given = family = None
    turned: Reading | None = None
    login = False
    named = [(w, g) for w in long if (g := _given(w, known))]
    if len(long) >= 2:
        if order_comma:
            family, first = long[0], long[1]
        elif named and len(named) < len(long):
            first = named[0][0]
            family = max((w for w in long if w != first), key=len)
        elif _family_first(bare):
            family, first = long[0], long[-1]
        else:
            first, family = long[0], long[-1]
            if not named and len(long) == 2:
                # Nothing tells the order.
                turned = (family, [first])
        given = _given(first, known) or first
    elif long and initials:
        letter = re.search(r"[^\W\d_]\W*$", bare)
        last = letter is not None and re.search(r"(?:^|[\s.])[^\W\d_]\W*$", bare) is not None
        if named or (last and not bare.islower()):
            # "Noor Q.": the initial stands for the family name.
            given = named[0][1] if named else long[0]
        else:
            given, family = initials[0], long[0]
    elif long:
        if named:
            given = named[0][1]
        else:
            # A login: initial and family name.
            given, family, login = long[0][0], long[0][1:], True
    else:
        return "", "", [], None

    from_mail = None
    if len(mail) >= 2:
        # A short form of several names is told by the mail address.
        own = given.split("/") if given else []
        other = next((w for w in mail if (g := _given(w, known)) and (given is None or g in own or g[0] == given[0])), None)
        if other and (_given(other, known) in own or (given and len(given) > 1 and lcs_ratio(long[0] if not family or long[0] != family else long[-1], other) >= 0.7)):
            given = _given(other, known)
        rest = [w for w in mail if w != other and len(w) > 2]
        if rest:
            from_mail = max(rest, key=lambda w: (lcs_ratio(w, family) if family else 0, len(w)))
        if other and given and len(given) == 1 and _given(other, known)[0] == given:
            given_by_mail = _given(other, known)
        else:
            given_by_mail = None
    else:
        given_by_mail = None
        if mail and given and len(mail[0]) > 4:
            fits = [g for g in given.split("/") if g[0] == mail[0][0]]
            if fits and "/" in given:
                given = "/".join(fits)
            from_mail = mail[0][1:] if fits else None
            if from_mail is None and family and lcs_ratio(mail[0], family) > 0.8:
                from_mail = mail[0]
    if family is None:
        return ("person", given or "", [from_mail], None) if from_mail and len(from_mail) > 3 else ("", given or "", [], None)
    if from_mail and lcs_ratio(from_mail, family) < 0.7:
        # The mail address names somebody else: a shared mailbox.
        from_mail = given_by_mail = None
    # A login that is no initial and family name has the whole family name in its mail.
    # Of a login of two or three letters too little is left for one.
    own = [] if login and len(family) < 3 else [family]
    return "person", given_by_mail or given, own + ([from_mail] if from_mail and from_mail != family else []), turned


_READING = "struct<given:string,family:array<string>>"
_PROFILE = f"identity string, kind string, known boolean, readings array<{_READING}>"
_WORDS = "author string, email string, words array<string>, mail array<string>, first string, last string"


def _suffixes(word: str, least: int) -> Column:
    """Every suffix of a word from ``least`` letters on, and of the word read backwards; a shorter word is its own."""
    ends = lambda w: F.expr(f"transform(sequence({least}, greatest(length({w}), {least})), n -> right({w}, n))")
    return F.concat(F.transform(ends(word), lambda x: F.concat(F.lit(">"), x)), F.transform(ends(f"reverse({word})"), lambda x: F.concat(F.lit("<"), x)))


def given_names(typed: DataFrame) -> DataFrame:
    """(word, given) of the words that are given names, or slips of one, by where they stand in (first, last) of the names of two words."""
    two = typed.where("first IS NOT NULL").select("first", "last").distinct()
    ahead = two.groupBy(F.col("first").alias("word")).agg(F.count("*").alias("ahead"))
    behind = two.groupBy(F.col("last").alias("word")).agg(F.count("*").alias("behind"))
    words = ahead.join(behind, "word", "full").select("word", F.coalesce("ahead", F.lit(0)).alias("ahead"), F.coalesce("behind", F.lit(0)).alias("behind"))
    words = cut(words)
    sure = words.where((F.col("ahead") >= GIVEN_PARTNERS) & (F.col("ahead") > F.col("behind")))
    # Slips are rare themselves, or at least much rarer than the name.
    seen = F.col("ahead") + F.col("behind")
    long = words.where(F.length("word") >= 4).select("word", F.when(seen < GIVEN_PARTNERS, 1).otherwise(seen * SLIP_RARITY).alias("asked"))
    left = long.select("word", "asked", F.explode(F.when(F.length("word") <= 5, _suffixes("word", 2)).otherwise(_suffixes("word", 3))).alias("key"))
    right = sure.where(F.length("word") >= 4).select(F.col("word").alias("given"), F.col("ahead").alias("held"), F.explode(_suffixes("word", 2)).alias("key"))
    near = left.join(right, "key").where((F.abs(F.length("word") - F.length("given")) <= 1) & (F.col("word") != F.col("given")) & (F.col("held") >= F.col("asked")))
    near = near.select("word", "given").distinct().where(_slip("word", "given"))
    slips = near.groupBy("word").agg(F.max_by("given", F.struct(_ratio("word", "given"), "given")).alias("given"))
    return sure.join(slips, "word", "left_anti").select("word", F.col("word").alias("given")).unionByName(slips)


def identity_profiles(commits: DataFrame) -> DataFrame:
    """(identity, kind, known, readings) of every distinct identity; a row without author has none.

    ``readings`` has one (given, family) or, where nothing tells the order of
    two words, both; ``known`` tells whether the given name is known for one.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for author, email in zip(batch["author"], batch["email"]):
                bare, words = _typed_words(author)
                long = [w for w in words if len(w) > 1]
                # Organisations and logins tell nothing about names.
                plain = len(long) == len(words) == 2 and " " in bare.strip() and not set(words) & _ORG_WORDS
                pair = (None, None) if not plain else (long[1], long[0]) if _family_first(bare) else (long[0], long[1])
                rows.append((author, email, words, _mail_parts(email)[0], *pair))
            yield pd.DataFrame(rows, columns=["author", "email", "words", "mail", "first", "last"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for author, email, learned in zip(batch["author"], batch["email"], batch["learned"]):
                known = {} if learned is None else {x["word"]: x["given"] for x in learned}
                kind, given, family, turned = profile(author, email, known)
                sure = all(g in _CANON.values() or g in known.values() for g in given.split("/"))
                readings = [{"given": g, "family": f} for g, f in [(given, family)] + ([turned] if turned else [])]
                rows.append((f"{author} <{email}>", kind, sure, readings))
            yield pd.DataFrame(rows, columns=["identity", "kind", "known", "readings"])

    tasks = int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = commits.where(F.col("author").isNotNull()).select("author", F.coalesce("email", F.lit("")).alias("email")).distinct()
    # Reading takes time and little data: spread over all tasks.
    typed = cut(distinct.repartition(tasks, "author", "email").mapInPandas(split, _WORDS))
    each = typed.select("author", "email", F.explode(F.array_distinct(F.concat("words", "mail"))).alias("word"))
    learned = each.join(given_names(typed), "word").groupBy("author", "email").agg(F.collect_list(F.struct("word", "given")).alias("learned"))
    whole = typed.select("author", "email").join(learned, ["author", "email"], "left").repartition(tasks, "author", "email")
    return whole.mapInPandas(read, _PROFILE)


def same_given(a: str, b: str, known_a: bool = False, known_b: bool = False) -> bool:
    """Whether two given names, or initials, can be one person's; two known names are one's only if they are equal."""
    if not a or not b:
        return a == b
    if a == b:
        return True
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    return not (known_a and known_b) and a[0] == b[0] and (lcs_ratio(a, b) >= 0.8 or sorted(a) == sorted(b))


@F.pandas_udf(T.BooleanType())
def _slip(word: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([slip_of(x, y) for x, y in zip(word, name)])


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_ratio(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.BooleanType())
def _same_given(a: pd.Series, b: pd.Series, known_a: pd.Series, known_b: pd.Series) -> pd.Series:
    return pd.Series([same_given(*x) for x in zip(a, b, known_a, known_b)])


def family_links(names: DataFrame) -> DataFrame:
    """(a, b) of names (name_id, kind, given, known, spelling) that agree, by suffix blocking; both ids in either order once.

    Identical (kind, given, spelling) rows should have been merged before.
    """
    keys = names.select("name_id", "kind", "given", "known", "spelling", F.explode(_suffixes("spelling", MIN_SUFFIX)).alias("suffix"))
    coarse = keys.withColumn("key", F.concat_ws("|", "kind", F.substring("given", 1, 1), "suffix"))
    sizes = coarse.groupBy("key").agg(F.count("*").alias("n"))
    sized = coarse.join(sizes.where(F.col("n") > 1), "key")
    many = sized.where(F.col("n") > COMMON).drop("n")
    fine = many.withColumn("key", F.concat_ws("|", "kind", "given", "suffix"))
    # An initial and the whole names it may stand for meet where their spellings are equal.
    equal = many.withColumn("key", F.concat_ws("|", "kind", F.substring("given", 1, 1), F.lit("="), "spelling")).dropDuplicates(["key", "name_id"])
    fine = fine.unionByName(equal)
    fine = fine.join(fine.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "key")
    used = sized.where(F.col("n") <= COMMON).unionByName(fine)
    # A key that is still common is met in blocks: each row of one side in one of them, of the other in all.
    blocks = F.ceil(F.col("n") / COMMON).cast("int")
    side = lambda x: used.select(
        "key", blocks.alias("blocks"), F.col("name_id").alias(x), F.col("given").alias(f"g{x}"), F.col("known").alias(f"k{x}"), F.col("spelling").alias(f"s{x}"),
        # The letter beyond the suffix: profiles that share it too meet under a longer one.
        F.when(blocks > 1, F.substring(F.when(F.col("suffix").startswith(">"), F.reverse("spelling")).otherwise(F.col("spelling")), F.length("suffix"), F.lit(1))).otherwise("").alias(f"x{x}"),
    )
    left = side("a").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).drop("blocks")
    right = side("b").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    long = 2 * F.least(F.length("sa"), F.length("sb")) >= RATIO * (F.length("sa") + F.length("sb"))
    near = left.join(right, ["key", "block"]).where((F.col("a") < F.col("b")) & long & ((F.col("xa") == "") | (F.col("xa") != F.col("xb"))))
    pairs = near.select("a", "b", "ga", "gb", "ka", "kb", "sa", "sb").distinct()
    return pairs.where((_ratio("sa", "sb") >= RATIO) & _same_given("ga", "gb", "ka", "kb"))


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of one task with what they connect joined to one member: no more rows, and shorter ways."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for x, y in zip(batch["x"].tolist(), batch["y"].tolist()):
            x, y = find(root.setdefault(x, x) if x not in root else x), find(root.setdefault(y, y) if y not in root else y)
            root[max(x, y)] = min(x, y)
    yield pd.DataFrame([(x, find(x)) for x in root], columns=["x", "y"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(member, component): the least member each member is connected with.

    Alternates between taking the least neighbour and the least of the
    neighbour's; each round is written to the checkpoint folder.
    """
    edges = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).mapInPandas(_contracted, "x long, y long")
    edges = cut(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("member"), F.least("x", "m").alias("component")))
    while True:
        around = edges.join(labels, edges["y"] == labels["member"]).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(around, labels["member"] == around["x"]).select("member", "component", F.least("component", "near").alias("next"))
        roots = step.select(F.col("member").alias("root"), F.col("next").alias("onward"))
        step = step.join(roots, step["next"] == roots["root"]).select("member", "component", F.least("next", "onward").alias("next"))
        step = cut(step)
        changed = not step.where("component <> next").isEmpty()
        labels = step.select("member", F.col("next").alias("component"))
        if not changed:
            return labels


def _without_ambiguous(links: DataFrame) -> DataFrame:
    """(a, b): the links, but those of initials that fit people of different given names.

    Names with a given name are joined first, and names with an initial among
    themselves; such a group joins the people only if all it fits are one.
    """
    short_a, short_b = F.length("ga") == 1, F.length("gb") == 1
    full = links.where(~short_a & ~short_b).select("a", "b")
    short = links.where(short_a & short_b).select("a", "b")
    across = links.where(short_a != short_b).select(F.when(short_a, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(short_a, F.col("b")).otherwise(F.col("a")).alias("f"))
    person = components(full).select(F.col("member").alias("f"), F.col("component").alias("person"))
    group = components(short).select(F.col("member").alias("s"), F.col("component").alias("group"))
    fits = across.join(person, "f", "left").join(group, "s", "left").select(F.coalesce("group", "s").alias("a"), F.coalesce("person", "f").alias("person"))
    single = fits.groupBy("a").agg(F.min("person").alias("b"), F.max("person").alias("other")).where("b = other").select("a", "b")
    return full.unionByName(short).unionByName(single)


def name_entities(commits: DataFrame) -> DataFrame:
    """(entity, identity): every identity with the entity it belongs to.

    An identity is ``author <email>`` as stored; a null email is an empty one
    and a null author is no identity.  The entity is named by its least
    identity.  A bot and a name that can't be read are entities of their own.
    An initial that fits several given names of one family links to none of
    them unless its mail address tells which.
    """
    profiles = cut(identity_profiles(commits))
    read = profiles.where(F.col("kind").isin("person", "org")).select("identity", "kind", "known", F.explode("readings").alias("r")).where(F.size("r.family") > 0)
    spelled = read.select("identity", "kind", F.explode(F.split("r.given", "/")).alias("given"), "known", F.explode("r.family").alias("spelling"))
    spelled = spelled.where(F.length("spelling") >= 2)
    name_id = F.xxhash64("kind", "given", "spelling")
    spelled = cut(spelled.withColumn("name_id", name_id))
    names = spelled.groupBy("name_id", "kind", "given", "spelling").agg(F.max("known").alias("known"))
    links = cut(family_links(names))
    kept = _without_ambiguous(links)

    # Spellings of one identity belong together too.
    firsts = spelled.groupBy("identity").agg(F.min("name_id").alias("a"))
    own = spelled.join(firsts, "identity").where(F.col("a") != F.col("name_id")).select("a", F.col("name_id").alias("b")).distinct()
    joined = components(kept.unionByName(own))
    at = firsts.join(joined, firsts["a"] == joined["member"], "left").select("identity", F.coalesce("component", "a").alias("component"))
    whole = profiles.select("identity").join(at, "identity", "left")
    group = F.when(F.col("component").isNull(), F.col("identity")).otherwise(F.col("component").cast("string"))
    return whole.withColumn("group", group).withColumn("entity", F.min("identity").over(Window.partitionBy("group"))).select("entity", "identity")


def same_entity_pairs(commits: DataFrame) -> DataFrame:
    """(identity_a, identity_b), identity_a < identity_b by code point: all pairs within an entity."""
    entities = cut(name_entities(commits))
    left = entities.select("entity", F.col("identity").alias("identity_a"))
    right = entities.select("entity", F.col("identity").alias("identity_b"))
    return left.join(right, "entity").where(F.col("identity_a") < F.col("identity_b")).select("identity_a", "identity_b")
