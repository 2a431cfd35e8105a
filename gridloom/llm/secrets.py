"""Secret scanning: candidates by pattern, false positives removed by a random forest.

A candidate is a value of 6 or more characters that a telling word is given, a dotted web token, or a run of 16 or more
characters that keys are written in. Its length, the changes between
kinds of characters, how much of it a dictionary covers, whether it stands in a path, and
the words beside it are its features. The forest is grown on the driver from a bounded number of
labelled findings and becomes arrays that built-in functions walk, so that scanning is DataFrame functions only.
"""

from __future__ import annotations

import json
import random
import string
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import texts_of

#: What a secret is assigned by: a telling word, and what stands between it and a value.
ASSIGNED = r"(?=[apstAPST])(?:(?<![A-Za-z])|(?=[APST]))(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\w{0,16}[\"']?\s{0,2}(?:=>|:=|[:=])\s{0,2}[\"'`]?"
#: A value of 6 or more characters after a telling word, a web token with its dots, or a run of 16 or more characters that keys are written in.
CANDIDATE = rf"{ASSIGNED}[^\s\"'`,;<>(){{}}\[\]]{{5,}}[^\s\"'`,;<>(){{}}\[\].:!?]|eyJ[A-Za-z0-9_\-]{{6,}}(?:\.[A-Za-z0-9_\-]{{6,}}){{1,2}}|(?<![A-Za-z0-9_+/=\-])[A-Za-z0-9_+/=\-]{{16,}}"
#: A character that no text may hold; put around candidates, it lets one pass of the pattern cut a text.
MARK, OTHER = "\ufdd0", "\ufdd1"
#: Characters of context before and after.
BEFORE, AFTER = 48, 16
#: Labelled findings that a forest is grown from at most, trees, depth, and rows of a leaf.
LABELLED, TREES, DEPTH, LEAF = 6000, 15, 6, 8
THRESHOLD = 0.5

#: Words of the dictionary by which coverage is told, and letters of the shortest of them.
WORDS, LETTERS = 300, 4
#: Beginnings of well-known kinds of keys.
PREFIX = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|sk_test_|rk_live_|sk-|AIza|eyJ|glpat-|npm_|SG_|dop_v1_|shpat_)"
#: Words before a secret, and before what only looks like one.
TELLING = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential|client[_ -]?secret|signing[_ -]?key)\w*[\"']?\s*(=>|:=|[:= ])?\s*[\"'`]?$"
HARMLESS = r"(?i)(sha-?(1|256|384|512)?|md5|commit|checksum|digest|uuid|guid|hash|etag|revision|rev|tree|blob|parent|integrity|fingerprint|crc|build|version|id|ref)\W{0,6}$"

FEATURES = ("n", "digits", "uppers", "vowels", "marks", "hex", "distinct", "kinds", "cases", "clusters", "repeats", "covered", "slashes", "in_path", "telling", "harmless", "quoted", "assigned", "prefix")


def dictionary(*vocabularies: str, words: int = WORDS) -> list[str]:
    """Frequent words: the first whole lower-case ASCII words of public vocabulary files, which list their pieces by frequency."""
    out: dict[str, None] = {}
    for path in vocabularies:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as file:
                ids = json.load(file)["model"]["vocab"]
            pieces: Iterable[str] = sorted(ids, key=ids.get)
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        own = (p[1:] for p in pieces if p[0] in "\u0120\u2581" and len(p) > LETTERS and p.isascii() is False and p[1:].isascii() and p[1:].isalpha() and p[1:].islower())
        out |= dict.fromkeys(islice(own, words))
    return [*out]


def features(known: list[str], c: str = "c", b: str = "b", a: str = "a") -> dict[str, Column]:
    """A double per feature, of columns with the candidate and what stands before and after it; ``known``: the dictionary."""
    it, before, after = F.col(c), F.col(b), F.col(a)
    share = lambda pattern, of=it: F.regexp_count(of, F.lit(pattern)) / F.length(it)
    words = "|".join(sorted(known, key=lambda w: (-len(w), w))) or "(?!)"
    columns = (
        F.length(it),
        share("[0-9]"),
        share("[A-Z]"),
        share("[aeiouAEIOU]"),
        share("[^A-Za-z0-9]"),
        it.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        F.size(F.array_distinct(F.split(it, ""))) / F.length(it),
        share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        share("[bcdfghjklmnpqrstvwxz]{4,}", F.lower(it)),
        share(r"(.)\1\1"),
        1 - F.length(F.regexp_replace(F.lower(it), words, "")) / F.length(it),
        F.regexp_count(it, F.lit("/")),
        before.rlike(r"(://|www\.|[/\\~.][A-Za-z0-9_.\-]*)$") | after.rlike(r"^([/\\]|\.[A-Za-z]{2,4}\b)"),
        before.rlike(TELLING),
        before.rlike(HARMLESS),
        before.rlike("[\"'`]$") & after.rlike("^[\"'`]"),
        before.rlike("[:=]\\s*[\"'`]?$"),
        it.rlike(PREFIX),
    )
    return {f"f_{name}": column.cast("double") for name, column in zip(FEATURES, columns, strict=True)}


# -- the forest -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """A leaf has a share of secrets; another splits at ``feature <= at``."""

    share: float
    feature: int = -1
    at: float = 0.0
    below: Node | None = None
    above: Node | None = None


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> Node:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF or share in (0.0, 1.0):
        return Node(share)
    best = (1e-9, -1, 0.0)
    now = share * (1 - share)
    for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5) + 1), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        left = np.arange(1, len(v))
        ok = (v[1:] > v[:-1]) & (left >= LEAF) & (len(v) - left >= LEAF)
        if not ok.any():
            continue
        p, q = ones[:-1] / left, (ones[-1] - ones[:-1]) / (len(v) - left)
        gain = now - (left * p * (1 - p) + (len(v) - left) * q * (1 - q)) / len(v)
        gain = np.where(ok, gain, -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
    if best[1] < 0:
        return Node(share)
    side = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], _grow(x[side], y[side], rng, depth - 1), _grow(x[~side], y[~side], rng, depth - 1))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 0) -> list[Node]:
    """Trees on resampled rows, each split over some of the features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows], rng, depth))
    return out


@dataclass(frozen=True)
class Forest:
    """Trees, and the dictionary of their features."""

    trees: list[Node]
    known: list[str]


def score(forest: Forest, x: Column) -> Column:
    """The mean of the trees' shares, over an array of features.

    Nodes of all trees lie in arrays, and each tree is walked from its root by as many steps as the deepest has; a leaf leads to itself. So
    the plan's size and its generated code don't grow with the forest.
    """
    rows: list[tuple[int, float, int, int, float]] = []

    def lay(node: Node) -> int:
        at = len(rows)
        rows.append((0, 0.0, at, at, node.share))
        if node.feature >= 0 and node.below is not None and node.above is not None:
            rows[at] = (node.feature, node.at, lay(node.below), lay(node.above), node.share)
        return at

    def deep(node: Node) -> int:
        return 0 if node.below is None or node.above is None else 1 + max(deep(node.below), deep(node.above))

    roots = [lay(t) for t in forest.trees]
    feature, at, below, above, share = (F.array(*[F.lit(r[k]) for r in rows]) for k in range(5))
    steps = F.sequence(F.lit(1), F.lit(max(1, *map(deep, forest.trees))))
    leaf = lambda root: F.aggregate(steps, root, lambda n, _: F.when(F.get(x, F.get(feature, n)) <= F.get(at, n), F.get(below, n)).otherwise(F.get(above, n)))
    return F.aggregate(F.array(*map(F.lit, roots)), F.lit(0.0), lambda total, root: total + F.get(share, leaf(root))) / len(roots)


def scored(named: DataFrame, forest: Forest) -> DataFrame:
    """``named`` (c, b, a and others) with ``score``."""
    x = F.array(*features(forest.known).values())
    return named.withColumn("score", F.get(F.transform(F.array(x), lambda own: score(forest, own)), F.lit(0)))  # bound, so made once for all trees


# -- labelled findings ----------------------------------------------------------------------


def labelled_findings(known: list[str], n: int = 5000, seed: int = 0) -> list[dict]:
    """Findings as a reviewer would have labelled them: keys in settings and code, and what is often taken for them."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    syllable = lambda: rng.choice("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve eau eux tion ment que sch ein ung ich ción ado".split())
    word = lambda: rng.choice(known)
    prose = lambda: " ".join("".join(syllable() for _ in range(rng.randint(1, 4))) for _ in range(6)) + rng.choice([" ", ". ", ", ", "\n"])
    keyword = lambda: rng.choice(["token", "api_key", "API_KEY", "apikey", "secret", "password", "passwd", "access_key", "auth_token", "client_secret", "SECRET_KEY", "private_key", "bearer", "Authorization: Bearer"])
    out = []
    for k in range(n):
        if k % 2:
            kind = rng.randrange(8)
            secret = [
                lambda: pick(hexa, rng.choice([32, 40, 48, 64])),
                lambda: pick(alnum, rng.randint(20, 64)),
                lambda: pick(b64, rng.choice([40, 44, 64, 86])) + rng.choice(["", "=", "=="]),
                lambda: rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16),
                lambda: rng.choice(["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "sk-", "AIza"]) + pick(alnum + "_-", rng.randint(24, 40)),
                lambda: pick(alnum + "_-", rng.randint(16, 32)),
                lambda: "".join(rng.sample([rng.choice(string.digits), rng.choice(string.ascii_uppercase), rng.choice("!@#$%^&*._-+"), *pick(alnum + "!@#$%._", rng.randint(5, 13))], k=8)) + pick(alnum, rng.randint(0, 6)),
                lambda: "eyJ" + pick(alnum, rng.randint(12, 30)) + ".eyJ" + pick(alnum + "_-", rng.randint(16, 60)) + "." + pick(alnum + "_-", 43),
            ][kind]()
            quote = rng.choice(['"', '"', "'", ""])
            bare = kind in (3, 4, 7) and rng.random() < 0.5
            before = prose() + ("" if bare else keyword() + rng.choice([" = ", "=", ": ", ":", " := ", " "]) + quote)
            after = ("" if bare else quote) + rng.choice([" ", "\n", ";", ", ", " "]) + prose()
        else:
            kind = rng.randrange(13)
            quote = rng.choice(['"', "'", "", ""])
            lead = prose()
            if kind == 0:
                secret, before = pick(hexa, rng.choice([40, 64, 32])), lead + rng.choice(["commit ", "sha256:", "sha1: ", "md5 = ", "checksum: ", "digest ", "parent ", "etag: "]) + quote
            elif kind == 1:
                secret, before = "-".join(pick(hexa, m) for m in (8, 4, 4, 4, 12)), lead + rng.choice(["uuid: ", "id = ", "guid=", ""]) + quote
            elif kind == 2:
                secret, before = "/".join(word() for _ in range(rng.randint(3, 6))), lead + rng.choice(["/", "~/", "path ", "src/", ""])
            elif kind == 3:
                secret, before = "/".join(word() for _ in range(3)) + "/" + pick(alnum, rng.randint(0, 24)), lead + rng.choice(["https://example.com/", "http://www.site.org/", "href="])
            elif kind == 4:
                secret, before = "".join(syllable() for _ in range(rng.randint(8, 14))).encode("ascii", "ignore").decode() or "syllables" * 2, lead
            elif kind == 5:
                secret, before = word() + "".join(word().capitalize() for _ in range(rng.randint(2, 5))), lead + rng.choice(["", "function ", "get", "new ", "call "])
            elif kind == 6:
                secret, before = "_".join(rng.choice([str.lower, str.upper])(word()) for _ in range(rng.randint(3, 6))), lead + rng.choice(["", "env ", "def ", keyword() + " = " + quote])
            elif kind == 7:
                secret, before = pick(string.digits, rng.randint(16, 24)), lead + rng.choice(["number ", "", "account ", "id: "])
            elif kind == 8:
                secret, before = rng.choice("=-_x*0") * rng.randint(16, 60), lead
            elif kind == 9:
                secret, before = rng.choice(["your_api_key_here", "YOUR_ACCESS_TOKEN_HERE", "example_token_value", "changemechangeme", "xxxxxxxxxxxxxxxxxxxx", "insert-your-key-here"]), lead + keyword() + rng.choice([" = ", ": ", "="]) + quote
            elif kind == 10:  # prose that a telling word leads to
                secret, before = rng.choice([word(), "".join(syllable() for _ in range(rng.randint(2, 5)))]).ljust(6, "e"), lead + rng.choice(["password", "token", "secret", "Password", "auth"]) + rng.choice([": ", " = ", ":"])
            elif kind == 11:  # code that a telling word leads to
                secret, before = rng.choice(["os.environ.get", "getenv", "config." + word(), "self." + word() + "_" + word(), word() + "." + word(), "None", "required", "string", "${" + word().upper()]).ljust(6, "s"), lead + keyword() + rng.choice([" = ", "=", ": "])
            else:
                secret, before = "-".join("".join(syllable() for _ in range(rng.randint(2, 3))) for _ in range(rng.randint(3, 7))), lead
            secret = secret if (len(secret) >= 16 or kind in (10, 11)) and secret.isascii() else (secret.encode("ascii", "ignore").decode() + "andmorewordsthere")
            after = quote + rng.choice([" ", "\n", ". ", ", "]) + prose()
        out.append({"c": secret, "b": before[-BEFORE:], "a": after[:AFTER], "secret": bool(k % 2)})
    return out


def train(spark: SparkSession, findings: list[dict], known: list[str], trees: int = TREES, depth: int = DEPTH, seed: int = 0) -> Forest:
    """Grow a forest from labelled findings (c, b, a, secret), LABELLED at most; the features are those of scanning, with the dictionary ``known``."""
    if len(findings) > LABELLED:
        raise ValueError(f"more than {LABELLED} findings")
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(findings)), "array<struct<c string, b string, a string, secret boolean>>")).alias("x")).select("x.*")
    table = np.array(rows.select(*[x.alias(n) for n, x in features(known).items()], F.col("secret").cast("double").alias("secret")).collect(), float)
    return Forest(grow(table[:, :-1], table[:, -1], trees, depth, seed), known)


# -- scanning -------------------------------------------------------------------------------


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, nth, start, c, b, a`` of every candidate in every whole text; ``start`` counts characters from 0. In a text that holds MARK, OTHER takes its place."""
    whole = F.regexp_replace(F.translate("text", MARK, OTHER), CANDIDATE, f"{MARK}$0{MARK}")
    own = texts_of(docs).withColumn("parts", F.split(whole, MARK, -1)).withColumn("_row", F.monotonically_increasing_id())
    every = lambda first: F.filter("parts", lambda _, k: k % 2 == first)
    cut = own.select("doc_id", "_row", every(1).alias("found"), every(0).alias("gaps"))
    # only the ends of gaps go on, so that a long text isn't repeated for each candidate; a telling word counts as what stands before
    told = F.regexp_extract("m", rf"^(?:{ASSIGNED})", 0)
    one = F.transform(F.col("found"), lambda m, k: F.struct(m.alias("m"), F.right(F.get("gaps", k), F.lit(BEFORE)).alias("b"), F.left(F.get("gaps", k + 1), F.lit(AFTER)).alias("a"), F.length(F.get("gaps", k)).alias("gap")))
    rows = cut.select("doc_id", "_row", F.posexplode(one).alias("nth", "x")).select("doc_id", "_row", "nth", "x.*").withColumn("told", told)
    passed = F.sum(F.col("gap") + F.length("m")).over(Window.partitionBy("_row").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = F.substring("m", F.length("told") + 1, F.length("m"))
    return rows.select("doc_id", "nth", (passed - F.length("m") + F.length("told")).alias("start"), c.alias("c"), F.right(F.concat("b", "told"), F.lit(BEFORE)).alias("b"), "a")


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, nth, start, n_chars, secret, score`` for each candidate that the forest takes for a secret.

    ``nth`` (from 0) counts candidates and ``start`` characters from 0. Candidates don't overlap: what begins first goes first. Texts that are null,
    empty or without candidates give no rows; repeated rows and repeated secrets give a row each. Other columns are not read.
    """
    found = scored(candidates(docs), forest).filter(F.col("score") >= threshold)
    return found.select("doc_id", "nth", "start", F.length("c").cast("long").alias("n_chars"), F.col("c").alias("secret"), "score")
