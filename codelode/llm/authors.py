"""Variant spellings of one person's name and address.

Distinct spellings are normalised to profiles (name tokens, address).  Equal
owned addresses and equal full names link at once, as a star to the smallest
profile of each key.  Names that differ are blocked by the phonetic codes of
their sorted tokens but one, with what that one shares with its slips, short
forms and abbreviations, addresses by what is left of them without one
character, so a block holds near neighbours only; candidates are compared with
Jaro-Winkler, a table of short forms and a rule on abbreviations, and need
evidence from an address, which must spell out the other name where the names
differ by a letter and both are common.  Accepted pairs are clustered by connected
components with pointer jumping.

Defined results
* A spelling is name, blank, ``<``, address, ``>``, as stored; null parts are
  empty.  Commits repeated any number of times count once.
* Automatic authors are left out.  Addresses of roles (``dev@``, ``git@``) and
  those without ``@`` say nothing about a person.
* A pair of different spellings of one person is one row, the smaller by code
  points first; a person with one spelling gives none.  Empty tables give empty
  results; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.staging import Staged, stage

#: Common short forms of given names.
SHORT_FORMS = {
    "alexander": ["alex", "xander", "sandy", "sasha", "al"], "amara": ["mara"], "anthony": ["tony", "ant"], "benjamin": ["ben", "benji", "benny"], "christopher": ["chris", "kit", "topher"],
    "daniel": ["dan", "danny"], "dmitri": ["dima", "mitya"], "elizabeth": ["liz", "beth", "eliza", "betty", "lizzie"], "francisco": ["paco", "pancho", "cisco", "fran"], "frederick": ["fred", "freddy", "freddie"],
    "gabriela": ["gabi", "gaby"], "jennifer": ["jen", "jenny"], "johannes": ["jo", "hans", "hannes"], "jonathan": ["jon", "jonny", "johnny"], "jurgen": ["jurg"],
    "katherine": ["kate", "kathy", "katie", "kat"], "margaret": ["maggie", "peggy", "meg", "greta"], "mateo": ["teo"], "michael": ["mike", "mick", "mickey", "mikey"],
    "nicholas": ["nick", "nicky", "klaus"], "oskar": ["ossi"], "quentin": ["quinn"], "rebecca": ["becca", "becky"], "robert": ["rob", "bob", "bobby", "robbie"],
    "samantha": ["sam", "sammy"], "stefan": ["steve", "stef", "steffen"], "theodora": ["thea", "theo", "dora"], "thomas": ["tom", "tommy"], "tomas": ["tom", "tommy"],
    "viktor": ["vik", "vic"], "william": ["will", "bill", "billy", "liam"], "yannick": ["yann"], "james": ["jim", "jimmy", "jamie"], "john": ["jack", "johnny"],
    "joseph": ["joe", "joey"], "richard": ["rick", "dick", "rich"], "edward": ["ed", "eddie", "ted"], "susan": ["sue", "susie"], "patricia": ["pat", "patty", "trish"], "andrew": ["andy", "drew"],
    "matthew": ["matt"], "joshua": ["josh"],
}
#: Local parts that stand for a role.
ROLES = frozenset(
    "dev git root info build builds engineering admin noreply no-reply release support team ci hello contact security ops devops webmaster postmaster mail office sales unknown none nobody user test".split()
)
#: Second labels under which countries give out domains.
SECOND_LEVEL = frozenset("ac co com edu gob gouv gov gv ltd net ne nom or org plc sch".split())
AUTOMATIC = r"(?i)\[bot\]|(^|[-_. ])(bot|runner|mirror|daemon|automation)$"
LEAST_SIMILARITY = 0.85
#: Two name parts one letter apart are both established, neither a slip of the
#: other, if the rarer has so many different partners and such a share of the
#: commoner's; a slip keeps its small share however large the table is.
ESTABLISHED, ESTABLISHED_SHARE = 5, 0.1
#: A domain with fewer full names is not known to be an organisation's.
LEAST_NAMES = 5

_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "AE", "ð": "d", "þ": "th", "đ": "d", "œ": "oe", "ı": "i"})
_UMLAUT = re.compile(r"([aou])e")


def _plain(word: str) -> str:
    """A folded word with written-out umlauts joined, as in the tokens of names."""
    return _UMLAUT.sub(r"\1", word)


_SHORT: dict[str, frozenset[str]] = {}
for _long, _forms in SHORT_FORMS.items():
    for _form in _forms:
        _SHORT[_plain(_form)] = _SHORT.get(_plain(_form), frozenset()) | {_plain(_long)}


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text.translate(_LETTERS))
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def name_tokens(name: str) -> list[str]:
    """Folded words of a name in sorted order, without notes in brackets; hyphens join."""
    text = fold(re.sub(r"\(.*?\)", " ", name)).replace("-", "").replace("'", "")
    return sorted(_plain(w) for w in re.split(r"[^\w]+|_+", text) if w)


def clean_address(address: str) -> tuple[str, str]:
    """(local part, domain) without brackets, tags, case and host names; empty where it names nobody."""
    text = fold(address).strip().strip("<>").strip()
    if text.count("@") != 1:
        return "", ""
    local, domain = text.split("@")
    local = local.split("+", 1)[1] if re.match(r"\d+\+", local) else local.split("+", 1)[0]
    parts = domain.split(".")
    # the organisation's own label and what it is registered under
    country = len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in SECOND_LEVEL
    domain = ".".join(parts[-3 if country else -2 :])
    return ("", "") if local in ROLES or not local else (local, domain)


def phonetic(word: str) -> str:
    """Consonant classes of a word in order, with its first letter, as in Soundex without a limit of length."""
    classes = {**dict.fromkeys("bfpvw", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6"}
    out, last = word[:1], classes.get(word[:1], "")
    for c in word[1:]:
        k = classes.get(c, "")
        if k and k != last:
            out += k
        if c not in "hw":
            last = k
    return out


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [b[j] for j in range(len(b)) if taken[j]]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def near(a: str, b: str) -> bool:
    """Equal, or one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def related(a: str, b: str, settled: bool) -> bool:
    """Whether two given names or surnames can be one: a slip, a short form, an abbreviation."""
    if a == b:
        return True
    if b in _SHORT.get(a, ()) or a in _SHORT.get(b, ()) or _SHORT.get(a, frozenset()) & _SHORT.get(b, frozenset()):
        return True
    short, long_ = sorted((a, b), key=len)
    if len(short) == 3 and len(long_) > 4 and long_.startswith(short):
        return True
    return near(a, b) and not settled and min(len(a), len(b)) >= 3


def established(a: str, b: str, partners: dict[str, int]) -> bool:
    """Whether two name parts with these numbers of partners are two names rather than one with a slip."""
    low, high = sorted((partners.get(a, 0), partners.get(b, 0)))
    return low >= ESTABLISHED and low >= ESTABLISHED_SHARE * high


def same_name(a: list[str], b: list[str], partners: dict[str, int]) -> bool:
    """Whether two full names can be spellings of one, token by token; without partners no part is established."""
    if len(a) != len(b) or len(a) < 2:
        return False
    for i in range(len(b)):
        turned = b[i:] + b[:i]
        ok = [related(x, y, established(x, y, partners)) for x, y in zip(a, turned)]
        if all(ok) and any(near(x, y) and len(x) >= 4 for x, y in zip(a, turned)):
            return True
    return False


def similarity(a: list[str], b: list[str]) -> float:
    """Largest Jaro-Winkler similarity of two names, short forms also read as what they stand for."""
    def readings(words: list[str], others: list[str]) -> list[str]:
        # a word of three letters also stands for a longer one of the other name that begins with it
        options = [[w, *_SHORT.get(w, ()), *(x for x in others if len(w) == 3 and len(x) > 4 and x.startswith(w))] for w in words]
        return [" ".join(sorted(x)) for x in product(*options)]

    return max(jaro_winkler(x, y) for x in readings(a, b) for y in readings(b, a))


def speaks_of(local: str, tokens: list[str]) -> bool:
    """Whether an address is made of this name."""
    plain = re.sub(r"[^a-z]", "", _plain(local))
    for i, given in enumerate(tokens):
        rest = "".join(tokens[:i] + tokens[i + 1 :])
        for form in (given + rest, rest + given, given[:1] + rest, rest + given[:1]):
            if len(form) >= 5 and near(plain, form):
                return True
    return False


def spells(local: str, tokens: list[str]) -> bool:
    """Whether an address is this name in full, letter by letter."""
    plain = re.sub(r"[^a-z]", "", _plain(local))
    return any(plain == "".join(tokens[i:] + tokens[:i]) for i in range(len(tokens)))


def fits(local: str, tokens: list[str]) -> bool:
    """Whether a name, if only initials or parts of one, does not speak against an address."""
    plain = re.sub(r"[^a-z]", "", _plain(local))
    return all(t in plain or t[:3] in plain or near(plain, t) or len(t) <= 2 and all(c in plain for c in t) for t in tokens) or speaks_of(local, tokens)


# --- profiles -----------------------------------------------------------------------------------


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, locals_, domains = [], [], []
        for n, e in zip(batch.column("author_name").to_pylist(), batch.column("author_email").to_pylist()):
            names.append(" ".join(name_tokens(n)))
            local, domain = clean_address(e)
            locals_.append(local)
            domains.append(domain)
        yield pa.record_batch(
            [batch.column("identity"), pa.array(names), pa.array(locals_), pa.array(domains)], names=["identity", "name", "local", "domain"]
        )


def profiles(commits: DataFrame) -> DataFrame:
    """(identity, name, local, domain) of each distinct spelling of people."""
    name, address = F.coalesce("author_name", F.lit("")), F.coalesce("author_email", F.lit(""))
    rows = commits.select(name.alias("author_name"), address.alias("author_email")).distinct()
    people = rows.where(~F.col("author_name").rlike(AUTOMATIC)).withColumn("identity", F.concat("author_name", F.lit(" <"), "author_email", F.lit(">")))
    return people.mapInArrow(_profile_batches, "identity string, name string, local string, domain string")


def _is_full(name: str = "name"):
    return F.size(F.filter(F.split(name, " "), lambda w: F.length(w) > 1)) >= 2


def _without_initials(name: str = "name"):
    return F.array_join(F.filter(F.split(name, " "), lambda w: F.length(w) > 1), " ")


def _star(nodes: DataFrame, *keys: str) -> DataFrame:
    """Edges from each node to the smallest node with the same key."""
    low = nodes.groupBy(*keys).agg(F.min("node").alias("a"))
    return nodes.join(low, list(keys)).where("a < node").select("a", F.col("node").alias("b"))


def _less(word: str) -> set[str]:
    """The word and what is left of it without one letter: words one slip apart share one of them."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _name_blocks(full: pd.Series) -> pd.Series:
    """Phonetic codes of the sorted other tokens, with what one token shares with its slips and short forms.

    An abbreviation (``<``) and what it may stand for (``>``) meet across the two marks only.
    """
    def keys(name: str) -> list[str]:
        words = name.split(" ")
        out = set()
        for i, w in enumerate(words):
            others = "|".join(sorted(phonetic(x) for j, x in enumerate(words) if j != i))
            for long_ in {w} | _SHORT.get(w, frozenset()):
                # as in the codes, the first letter holds
                out |= {f"={others}/{long_[:1]}/{x}" for x in (_less(long_) if len(long_) >= 3 else {long_})}
            if len(w) == 3:
                out.add(f"<{others}/{w}")
            elif len(w) > 4:
                out.add(f">{others}/{w[:3]}")
        return sorted(out)

    return full.map(keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _less_one(local: pd.Series) -> pd.Series:
    return local.map(lambda s: sorted(_less(s)) if len(s) >= 5 else [s])


def _pairs_across(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    a = left.select(key, *[F.col(c).alias(f"{c}_a") for c in columns])
    b = right.select(key, *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, key).drop(key)


def _pair_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs of different rows that share a key, each once; rows are (node, key, columns)."""
    return _pairs_across(df, df, key, columns).where(f"{columns[0]}_a < {columns[0]}_b").distinct()


def _check_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of names that can be one; ``sure`` asks for an address that spells out the other name."""
    for batch in batches:
        rows = batch.to_pydict()
        keep, sure = [], []
        for a, b, pa_, pb in zip(rows["full_a"], rows["full_b"], rows["partners_a"], rows["partners_b"]):
            a, b = a.split(" "), b.split(" ")
            keep.append(same_name(a, b, {}) and similarity(a, b) >= LEAST_SIMILARITY)
            sure.append(keep[-1] and not same_name(a, b, {x["w"]: x["n"] for x in [*pa_, *pb]}))
        pairs = pa.record_batch([batch.column("full_a"), batch.column("full_b"), pa.array(sure, pa.bool_())], names=["full_a", "full_b", "sure"])
        yield pairs.filter(pa.array(keep, pa.bool_()))


def _check_evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        keep = [bool(l) and (spells if sure else speaks_of)(l, other.split(" ")) for l, other, sure in zip(rows["local"], rows["other"], rows["sure"])]
        yield batch.select(["full_a", "full_b"]).filter(pa.array(keep, pa.bool_()))


def _check_addresses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        keep = []
        for la, lb, na, nb in zip(*(rows[c] for c in ("local_a", "local_b", "name_a", "name_b"))):
            a, b = na.split(" "), nb.split(" ")
            full = [[w for w in x if len(w) > 1] for x in (a, b)]
            if len(full[0]) >= 2 and len(full[1]) >= 2:
                agree = full[0] == full[1] or same_name(*full, {})
            else:
                agree = fits(la, b) and fits(lb, a) or fits(la, a) and fits(la, b)
            keep.append(near(la, lb) and agree)
        yield batch.select(["node_a", "node_b"]).filter(pa.array(keep, pa.bool_()))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): accepted pairs of the profiles (node, name, local, domain)."""
    owned = nodes.where("local <> ''")
    by_address = _star(owned, "local", "domain")
    named = nodes.where(_is_full()).withColumn("full", _without_initials())
    by_name = _star(named.select("node", "full"), "full")

    # what a domain is: of an organisation, or of a mail service whose users also have other addresses
    spread_ = named.where("domain <> ''").groupBy("full").agg(F.min("domain").alias("d0"), F.max("domain").alias("d1"))
    domains = named.where("domain <> ''").select("full", "domain").distinct().join(spread_, "full").groupBy("domain").agg(
        F.avg((F.col("d0") != F.col("d1")).cast("double")).alias("elsewhere"), F.count(F.lit(1)).alias("n")
    )
    org = owned.select("node", "domain").join(domains.where((F.col("elsewhere") < 0.5) & (F.col("n") >= LEAST_NAMES)), "domain", "left_semi").select("node", F.col("domain").alias("org"))

    # distinct full names with their organisation and the numbers of partners of their parts
    words = named.select("full", F.explode(F.split("full", " ")).alias("w")).distinct()
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    partners = words.join(counts, "w").groupBy("full").agg(F.sort_array(F.collect_set(F.struct("w", "n"))).alias("partners"))
    # a person may have had several employers; one in common is enough
    code = F.when(F.col("org").isNotNull(), F.xxhash64("org"))
    orgs = named.join(org, "node", "left").groupBy("full").agg(F.sort_array(F.collect_set(code)).alias("orgs"))
    orgs = orgs.withColumn("orgs", F.when(F.size("orgs") > 0, F.col("orgs")))
    names = stage(orgs.join(partners, "full").select("full", "partners", "orgs", F.explode(_name_blocks("full")).alias("key"))).df
    mark, rest = F.left("key", F.lit(1)), F.substr("key", F.lit(2)).alias("key")
    short, long_ = (names.where(mark == m).select("full", "partners", "orgs", rest) for m in "<>")
    pairs = _pair_rows(names.where(mark == "=").select("full", "partners", "orgs", rest), "key", ["full", "partners", "orgs"])
    turned = F.col("full_a") < F.col("full_b")
    across = _pairs_across(short, long_, "key", ["full", "partners", "orgs"]).where("full_a <> full_b")
    across = across.select(*[F.when(turned, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for c in ("full", "partners", "orgs") for x, y in ("ab", "ba")])
    pairs = pairs.unionByName(across).distinct().where("orgs_a is null or orgs_b is null or arrays_overlap(orgs_a, orgs_b)")
    close = stage(pairs.mapInArrow(_check_names, "full_a string, full_b string, sure boolean")).df
    addresses = named.where("local <> ''").select("full", "local").distinct()
    evidence = (
        close.join(addresses, close["full_a"] == addresses["full"]).select("full_a", "full_b", "sure", "local", F.col("full_b").alias("other"))
        .unionByName(close.join(addresses, close["full_b"] == addresses["full"]).select("full_a", "full_b", "sure", "local", F.col("full_a").alias("other")))
        .mapInArrow(_check_evidence, "full_a string, full_b string")
        .distinct()
    )
    first = named.groupBy("full").agg(F.min("node").alias("node"))
    a, b = first.select(F.col("full").alias("full_a"), F.col("node").alias("a")), first.select(F.col("full").alias("full_b"), F.col("node").alias("b"))
    by_slip = evidence.join(a, "full_a").join(b, "full_b").select("a", "b")

    # addresses one character apart within a domain
    heads = owned.groupBy("local", "domain", "name").agg(F.min("node").alias("node"))
    keyed = heads.select("node", "local", "name", "domain", F.explode(_less_one("local")).alias("rest")).withColumn("key", F.concat_ws("@", "rest", "domain"))
    by_typo = _pair_rows(keyed, "key", ["node", "local", "name"]).mapInArrow(_check_addresses, "node_a long, node_b long").select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")
    )
    return by_address.unionByName(by_name).unionByName(by_slip).unionByName(by_typo).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component, by label passing with pointer jumping."""
    e = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels: Staged = stage(e.df.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        around = e.df.join(labels.df, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low")).withColumnRenamed("a", "node")
        passed = labels.df.join(around, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        jump = labels.df.select(F.col("node").alias("label"), F.col("label").alias("next"))
        nxt = stage(passed.join(jump, "label").select("node", F.least("label", "next").alias("label"), "was"), moved=F.count_if(F.col("label") != F.col("was")))
        moved = nxt.seen["moved"]
        labels.drop()
        labels = Staged.of(nxt, "node", "label")
        if not moved:
            return labels.df.withColumnRenamed("label", "component")


def persons(commits: DataFrame) -> DataFrame:
    """(identity, person): every spelling of people with the number of its person."""
    p = stage(profiles(commits)).df
    distinct = p.groupBy("name", "local", "domain").agg(F.min("identity").alias("first"))
    nodes = stage(distinct.withColumn("node", F.xxhash64("name", "local", "domain"))).df
    found = components(links(nodes.select("node", "name", "local", "domain")))
    numbered = nodes.join(found, "node", "left").select("name", "local", "domain", F.coalesce("component", "node").alias("person"))
    return p.join(numbered, ["name", "local", "domain"]).select("identity", "person")


def same_person_pairs(commits: DataFrame) -> DataFrame:
    """(identity_a, identity_b): all pairs of different spellings of one person."""
    s = stage(persons(commits).distinct()).df
    a, b = s.withColumnRenamed("identity", "identity_a"), s.withColumnRenamed("identity", "identity_b")
    return a.join(b, "person").where("identity_a < identity_b").select("identity_a", "identity_b").distinct()
