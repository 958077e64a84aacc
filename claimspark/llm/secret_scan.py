"""Secret scans: pattern candidates, filtered by a random forest, in DataFrame functions only.

Candidates are long tokens that mix letters and digits, values assigned to a word that names a secret and
private keys from header to footer. Random forests, grown in plain Python on the driver from labelled
findings, remove false positives: one judges tokens by length, character transitions, dictionary coverage, path and
neighbouring words, the other judges values assigned to a name (or given in an address before @) by the name, the
sign of assignment, quotes, length, classes of characters, and whether they are numbers, calls, references, types or plain
words. Their trees become CASE expressions, so that scoring stays inside Spark SQL; nothing is shuffled, and a
text's candidates never leave its row.

The labelled findings are examples made from published secret formats and from look-alikes (checksums,
commit ids, UUIDs, paths, versions, identifiers; numbers, calls, types and prose after a colon): N_EXAMPLES of each
kind, from a fixed seed.

A token that is judged a secret goes wherever it stands. So does an assigned value of EVERYWHERE characters or more with one
that is no letter; shorter ones and plain words go only where they are assigned, since elsewhere the same letters are
mostly ordinary words. `secrets` lists what isn't part of a longer secret.

Null texts are empty and have no candidates. Repeated rows and null ids are scanned row by row; texts
are scanned whole. An empty table gives an empty result. All input columns stay; result columns of the
same name replace them. Equal candidates in one text count once; each occurrence is judged by the text
before it, and one that is a secret makes all of them so.
"""

from __future__ import annotations

import math
import random
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Candidates: a private key from header to footer (without a footer, the header and the lines of key
#: material after it), an access-key id, or a run of token characters, long and mixed enough. All runs are
#: possessive, so that the time is linear in the text.
KEY_NAME = r"[A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
PRIVATE_KEY = rf"-----BEGIN {KEY_NAME}(?:(?:[^-]++|-(?!----))*+-----END {KEY_NAME}|(?:\s++[A-Za-z0-9+/]{{16,}}+={{0,2}})*+)"
CANDIDATE = PRIVATE_KEY + r"|(?<![A-Za-z0-9+/_.-])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9+/_=-])|(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])(?=[0-9+/_.-]*+[A-Za-z])[A-Za-z0-9+/_.-]{12,}+={0,2}"
#: A private key is judged by its header.
KEY_BODY = r"^(-----BEGIN [A-Z ]{1,40}-----)[\s\S]*"
MASK = "[SECRET]"
N_EXAMPLES = 3000
CONTEXT = 40

#: Words that name a secret, and words that name something harmless, before a candidate.
SECRET_WORDS = "password|passwd|pwd|secret|token|api_key|apikey|api-key|access_key|auth|credential|private|bearer"
HARMLESS_WORDS = "commit|sha|md5|checksum|digest|uuid|guid|version|build|revision|etag|release|id|ref|hash"
#: Frequent word parts of code and prose; what they cover of a token is no key material.
DICTIONARY = "able|account|action|admin|after|and|app|archive|base|build|cache|case|check|class|client|code|com|config|content|core|count|data|date|debug|default|dev|doc|document|event|example|feature|field|file|final|folder|for|form|from|function|get|group|handler|home|html|image|index|info|item|lib|line|link|list|local|log|main|manager|map|master|message|model|module|name|net|node|number|object|org|page|path|photo|post|product|project|public|query|readme|record|release|report|request|result|root|script|section|server|service|session|set|source|src|start|state|static|status|string|system|table|task|temp|test|text|the|time|title|type|update|user|util|value|version|video|view|web|with|work"

#: What is assigned to a secret's name and is none: literals, types, placeholders, references.
NO_VALUE = r"(?:null|none|nil|true|false|undefined|str|string|int|integer|bool|boolean|bytes|optional|required|x{3,}|\*{3,}|\[secret\]|(?:your|my)[_ -][a-z_ -]*|changeme|<[^>\s]*>|\$\{?\w+\}?|\{\{[^}]*\}\}|%\w+%|(?:os\.|process\.|env\.|self\.|config\.|getenv)[\w.]*(?:[\[(]\S*)?)"
#: A value assigned to a secret-naming word (group 2): quoted, or up to white space; short ones too. After
#: words that prose uses and ": ", a plain lower-case word is prose. Java only: Python has no such lookbehind.
ASSIGNED = (
    rf"((?i:(?:{SECRET_WORDS}|passphrase)(?:[_-]?key)?)[\"']?\s{{0,3}}(?::=|=>|={{1,2}}|:(?!//))\s{{0,3}}[\"']?+)"
    rf"(?!-----BEGIN)(?!(?i:{NO_VALUE})(?:[\"',;.)\]}}\s]|$))(?!(?<=(?i:token|secret|auth|private|bearer|credential):\s)[a-z]++[.,;!?]?(?:\s|$))"
    r"""((?<=")(?:(?:[^"\\\r\n]|\\.)++(?=")|\S++)|(?<=')(?:(?:[^'\\\r\n]|\\.)++(?=')|\S++)|(?<!["'])(?:(?!&\w{1,40}=)\S)*[^\s"',;.&)\]}])"""
)
#: A password in an address (group 2): scheme://user:password@host.
IN_ADDRESS = r"([A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]{1,100}:)([^\s:/@]{1,200})(?=@[A-Za-z0-9])"
#: An assigned value of so many characters is masked wherever the text has it.
EVERYWHERE = 8

FEATURES = ("length", "transitions", "digits", "upper", "covered", "longest_letters", "path", "secret_before", "harmless_before", "assigned", "hexadecimal", "prefix")
PREFIX = r"^(AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|AIza|eyJ|-----BEGIN)"


def features(token: str, before: str) -> tuple[float, ...]:
    """The features of FEATURES in Python; feature_columns says the same in Spark."""
    token = re.sub(KEY_BODY, r"\1", token)
    n = len(token)
    kinds = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", token)))
    return (
        float(n),
        (len(re.sub(r"(.)\1+", r"\1", kinds)) - 1) / n,
        len(re.sub(r"[^0-9]", "", token)) / n,
        len(re.sub(r"[^A-Z]", "", token)) / n,
        1 - len(re.sub(rf"({DICTIONARY})", "", token.lower())) / n,
        float(max(map(len, re.split(r"[^A-Za-z]", token)))),
        float(len(re.sub(r"[^/.]", "", token))),
        float(bool(re.search(rf"(?i)({SECRET_WORDS})[^A-Za-z0-9]{{0,8}}$", before))),
        float(bool(re.search(rf"(?i)\b({HARMLESS_WORDS})[^A-Za-z0-9]{{0,8}}$", before))),
        float(bool(re.search(r"[=:]\s{0,3}[\"']?$", before))),
        float(bool(re.search(r"^([0-9a-f-]+|[0-9A-F-]+)$", token))),
        float(bool(re.search(PREFIX, token))),
    )


def feature_columns(token: Column, before: Column) -> dict[str, Column]:
    token = F.regexp_replace(token, KEY_BODY, "$1")
    n = F.length(token).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    kept = lambda pattern: F.length(F.regexp_replace(token, pattern, "")).cast("double")
    flag = lambda column, pattern: F.when(column.rlike(pattern), 1.0).otherwise(0.0)
    return {
        "length": n,
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "digits": kept("[^0-9]") / n,
        "upper": kept("[^A-Z]") / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(token), f"({DICTIONARY})", "")) / n,
        "longest_letters": F.array_max(F.transform(F.split(token, "[^A-Za-z]"), lambda x: F.length(x))).cast("double"),
        "path": kept("[^/.]"),
        "secret_before": flag(before, f"(?i)({SECRET_WORDS})[^A-Za-z0-9]{{0,8}}$"),
        "harmless_before": flag(before, rf"(?i)\b({HARMLESS_WORDS})[^A-Za-z0-9]{{0,8}}$"),
        "assigned": flag(before, r"[=:]\s{0,3}[\"']?$"),
        "hexadecimal": flag(token, "^([0-9a-f-]+|[0-9A-F-]+)$"),
        "prefix": flag(token, PREFIX),
    }


def labelled_findings(n: int = N_EXAMPLES, seed: int = 42) -> list[tuple[str, str, int]]:
    """(token, text before it, 1 for a secret): made from formats, deterministic."""
    rnd = random.Random(seed)
    hexa, base32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    base62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    words, names = DICTIONARY.split("|"), SECRET_WORDS.split("|")
    prose = ("in the ", "we found ", "see also ", "and then ", "of this, ", "\n", "")
    mark = lambda: rnd.choice(["=", " = ", ": ", '="', ' = "', ": '"])

    def secret() -> tuple[str, str]:
        kind = rnd.randrange(8)
        key = f"{rnd.choice(prose)}{rnd.choice(names)}{mark()}"
        if kind == 0:
            return rnd.choice(["AKIA", "ASIA"]) + pick(base32, 16), rnd.choice([*prose, key])
        if kind == 1:
            return rnd.choice(["ghp_", "gho_", "ghs_"]) + pick(base62, 36), rnd.choice([*prose, key])
        if kind == 2:
            return rnd.choice(["sk-", "sk_live_", "glpat-", "AIza"]) + pick(base62 + "_-", rnd.randint(20, 48)), rnd.choice([*prose, key])
        if kind == 3:
            return "eyJ" + pick(base62, 30) + "." + pick(base62 + "_-", 60) + "." + pick(base62 + "_-", 43), rnd.choice([*prose, key])
        if kind == 4:
            return pick(hexa, rnd.choice([16, 18, 20, 24, 32, 40, 64])), key
        if kind == 5:
            return pick(base62 + "+/", rnd.choice([20, 24, 32, 40, 44, 64])), key
        if kind == 6:
            return pick(base62, rnd.randint(12, 20)), key
        return f"-----BEGIN {rnd.choice(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----", rnd.choice(prose)

    def harmless() -> tuple[str, str]:
        kind = rnd.randrange(9)
        named = f"{rnd.choice(prose)}{rnd.choice(HARMLESS_WORDS.split('|'))}{rnd.choice([' ', ': ', '=', ' is '])}"
        if kind == 0:
            return pick(hexa, rnd.choice([32, 40, 64])), rnd.choice([named, *prose])
        if kind == 1:
            return "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), rnd.choice([named, *prose])
        if kind == 2:
            return "/".join(rnd.choice(words) for _ in range(rnd.randint(2, 5))) + f"{rnd.randint(0, 9999)}." + rnd.choice(["html", "png", "py", "jpg"]), rnd.choice([*prose, "http://", "path: "])
        if kind == 3:
            return ".".join(str(rnd.randint(0, 99)) for _ in range(4)) + "-" + rnd.choice(words) + "." + pick("0123456789", 6), rnd.choice([named, *prose])
        if kind == 4:
            return "_".join(rnd.choice(words) for _ in range(rnd.randint(2, 4))) + str(rnd.randint(0, 999)), rnd.choice([*prose, f"{rnd.choice(words)}{mark()}"])
        if kind == 5:
            return "".join(rnd.choice(words).title() for _ in range(3)) + str(rnd.randint(0, 99)), rnd.choice([*prose, f"{rnd.choice(names)}{mark()}"])
        if kind == 6:
            return rnd.choice(words) + "." + rnd.choice(words) + str(rnd.randint(1, 999)) + ".example.com", rnd.choice([*prose, "mail "])
        if kind == 7:
            return f"20{rnd.randint(10, 30)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}T{rnd.randint(10, 23)}-00", rnd.choice([*prose, named])
        return rnd.choice(words) + "-" + rnd.choice(words) + "-" + str(rnd.randint(1000, 999999)), rnd.choice([*prose, named])

    out = []
    for k in range(n):
        token, before = secret() if k % 2 == 0 else harmless()
        filler = "".join(rnd.choice(words) + " " for _ in range(6))
        out.append((token, (filler + before)[-CONTEXT:], 1 - k % 2))
    return out


PASSWORDS = "password|passwd|pwd|passphrase"
ASSIGNED_FEATURES = ("password", "key", "colon", "spaced", "quoted", "length", "digits", "symbols", "classes", "number", "call", "reference", "identifier", "capitalised", "lower_word", "covered", "transitions")
#: Shapes of a value: number, call or subscript, dotted reference, identifier of parts, capitalised name, small letters.
SHAPES = {
    "number": r"^[+-]?[0-9][0-9_.,]*[a-zA-Z%]?$",
    "call": r"^[A-Za-z_][\w.:]*[\[(<{]",
    "reference": r"^[A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)+$",
    "identifier": r"^[A-Za-z]+(?:_[A-Za-z]+)+$",
    "capitalised": r"^(?:[A-Z][a-z]+)+$",
    "lower_word": r"^[a-z]+$",
}


def assigned_features(head: str, value: str) -> tuple[float, ...]:
    """The features of ASSIGNED_FEATURES in Python: head is the name, the sign and the quote before a value."""
    n = len(value)
    kinds = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", value)))
    return (
        float(bool(re.search(f"(?i)({PASSWORDS}|://)", head))),
        float(bool(re.search("(?i)key", head))),
        float(bool(re.search(r":\s*[\"']?$", head))),
        float(bool(re.search(r"\s[\"']?$", head))),
        float(bool(re.search(r"[\"']$", head))),
        float(n),
        len(re.sub(r"[^0-9]", "", value)) / n,
        len(re.sub(r"[A-Za-z0-9_.]", "", value)) / n,
        float(sum(bool(re.search(x, value)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))),
        *(float(bool(re.search(x, value))) for x in SHAPES.values()),
        1 - len(re.sub(rf"({DICTIONARY})", "", value.lower())) / n,
        (len(re.sub(r"(.)\1+", r"\1", kinds)) - 1) / n,
    )


def assigned_columns(head: Column, value: Column) -> dict[str, Column]:
    n = F.length(value).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    flag = lambda column, pattern: F.when(column.rlike(pattern), 1.0).otherwise(0.0)
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    classes = [flag(value, x) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
    return {
        "password": flag(head, f"(?i)({PASSWORDS}|://)"),
        "key": flag(head, "(?i)key"),
        "colon": flag(head, r":\s*[\"']?$"),
        "spaced": flag(head, r"\s[\"']?$"),
        "quoted": flag(head, r"[\"']$"),
        "length": n,
        "digits": share("[^0-9]"),
        "symbols": share(r"[A-Za-z0-9_.]"),
        "classes": classes[0] + classes[1] + classes[2] + classes[3],
        **{k: flag(value, x) for k, x in SHAPES.items()},
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), f"({DICTIONARY})", "")) / n,
        "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
    }


def labelled_assignments(n: int = N_EXAMPLES, seed: int = 43) -> list[tuple[str, str, int]]:
    """(head, value, 1 for a secret): values after a naming word, made from formats, deterministic."""
    rnd = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    base62 = digits + lower.upper() + lower
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    vowels = lambda k: "".join(rnd.choice("bcdfghklmnprstvw") + rnd.choice("aeiou") + rnd.choice(("", "", "n", "r", "s")) for _ in range(k))
    word = lambda: rnd.choice((rnd.choice(DICTIONARY.split("|")), vowels(rnd.randint(1, 4))))
    passwords, names = PASSWORDS.split("|"), [x for x in SECRET_WORDS.split("|") if x not in PASSWORDS.split("|")]
    signs = ("=", " = ", ": ", ":", '="', ' = "', ': "', "='", " => '")
    bare = [x for x in signs if x[-1] not in "\"'"]
    head = lambda group, some=signs: rnd.choice(group) + rnd.choice(some)

    def secret() -> tuple[str, str]:
        kind = rnd.randrange(8)
        if kind == 0:
            return head(names + passwords), pick(base62, rnd.randint(10, 40)) + rnd.choice(digits)
        if kind == 1:
            return head(passwords + names), word().title() + pick(digits, rnd.randint(1, 4)) + pick("!@#$%&*?+-", rnd.randint(1, 2)) + pick(base62, rnd.randint(0, 4))
        if kind == 2:
            return head(passwords + names[:2]), pick("!@#$%&*?+-" + base62, rnd.randint(7, 20)) + pick("!@#$%&*?", 1)
        if kind == 3:
            return head(passwords), rnd.choice("- _").join(word() for _ in range(3)) if rnd.random() < 0.5 else "-".join(word() for _ in range(rnd.randint(2, 4)))
        if kind == 4:
            return head(passwords, ("=", ": ", ":", '="', ' = "')), word()
        if kind == 5:
            return head(names + passwords), pick(digits + "abcdef", rnd.choice((16, 20, 32, 40)))
        if kind == 6:
            return head([*passwords, "postgres://admin:"], ("=", ": ", "")), word() + pick(digits, rnd.randint(1, 4))
        return head(passwords), pick(digits, rnd.randint(4, 10))

    def harmless() -> tuple[str, str]:
        kind = rnd.randrange(9)
        if kind == 0:
            return head(names, bare), rnd.choice((str(rnd.randint(0, 9999)), f"{rnd.random() * 100:.2f}", f"{rnd.randint(1, 90)}s", f"-{rnd.randint(1, 9)}", f"{rnd.randint(1, 9)}_000"))
        if kind == 1:
            parts = "_".join(word() for _ in range(rnd.randint(1, 3)))
            inside = rnd.choice(("", word(), f"{word()}.{word()}", f"'{word()}'"))
            return head(names + passwords, bare), rnd.choice((parts, f"{word()}.{parts}", word().title())) + "(" + inside
        if kind == 2:
            return head(names + passwords, bare), ".".join(word() for _ in range(rnd.randint(2, 3))) if rnd.random() < 0.7 else f"{word()}.{word()}_{word()}"
        if kind == 3:
            return head(names + passwords, bare), rnd.choice(("_".join(word() for _ in range(rnd.randint(2, 3))), "_".join(word().upper() for _ in range(2))))
        if kind == 4:
            return head(names + passwords, (": ", ":", " = ")), "".join(word().title() for _ in range(rnd.randint(1, 3))) + rnd.choice(("", "", "[str", "[" + word().title()))
        if kind == 5:
            return head(names, (": ",)), word().title()
        if kind == 6:
            return head(names, (": ", ":", "=", " = ")), word()
        if kind == 7:
            return head(names, bare), rnd.choice(("{", "[", "lambda:", "await", "new", "&" + word(), "*" + word(), "/".join(word() for _ in range(3))))
        return head(names, ('="', ' = "', ': "')), rnd.choice((word(), f"{word()} {word()}", f"{word()}_{word()}", f"{word()}-{word()}"))

    return [(*(secret() if k % 2 == 0 else harmless()), 1 - k % 2) for k in range(n)]


def grow(rows: list, labels: list[int], idx: list[int], rnd: random.Random, depth: int, tries: int):
    """A tree: a leaf's share of secrets, or (feature, threshold, below or equal, above)."""
    share = sum(labels[i] for i in idx) / len(idx)
    if depth == 0 or share in (0.0, 1.0) or len(idx) < 10:
        return share
    best = None
    for f in rnd.sample(range(len(rows[0])), tries):
        order = sorted(idx, key=lambda i: rows[i][f])
        total, left = sum(labels[i] for i in idx), 0
        for k in range(1, len(order)):
            left += labels[order[k - 1]]
            low, high = rows[order[k - 1]][f], rows[order[k]][f]
            if low == high:
                continue
            a, b = left / k, (total - left) / (len(order) - k)
            impurity = k * a * (1 - a) + (len(order) - k) * b * (1 - b)
            if best is None or impurity < best[0]:
                best = (impurity, f, (low + high) / 2)
    if best is None:
        return share
    _, f, at = best
    below = [i for i in idx if rows[i][f] <= at]
    above = [i for i in idx if rows[i][f] > at]
    return (f, at, grow(rows, labels, below, rnd, depth - 1, tries), grow(rows, labels, above, rnd, depth - 1, tries))


@cache
def train_forest(trees: int = 12, depth: int = 5, seed: int = 7, n: int = N_EXAMPLES) -> tuple:
    """A random forest: bootstrap samples, a random third of the features at each split."""
    found = labelled_findings(n)
    rows, labels = [features(t, b) for t, b, _ in found], [y for _, _, y in found]
    rnd = random.Random(seed)
    return tuple(grow(rows, labels, [rnd.randrange(n) for _ in range(n // 2)], rnd, depth, math.ceil(len(FEATURES) / 3)) for _ in range(trees))


@cache
def train_assigned(trees: int = 12, depth: int = 6, seed: int = 8, n: int = N_EXAMPLES) -> tuple:
    """The forest that judges assigned values, grown as the other."""
    found = labelled_assignments(n)
    rows, labels = [assigned_features(h, v) for h, v, _ in found], [y for _, _, y in found]
    rnd = random.Random(seed)
    return tuple(grow(rows, labels, [rnd.randrange(n) for _ in range(n // 2)], rnd, depth, math.ceil(len(ASSIGNED_FEATURES) / 3)) for _ in range(trees))


def vote(forest: tuple, row: tuple[float, ...]) -> float:
    total = 0.0
    for tree in forest:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        total += tree
    return total / len(forest)


def forest_column(forest: tuple, value: Column, names: tuple[str, ...] = FEATURES) -> Column:
    """The forest's mean vote as CASE expressions over a struct of its features."""

    def tree(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(float(t))
        f, at, below, above = t
        return F.when(value[names[f]] <= F.lit(float(at)), tree(below)).otherwise(tree(above))

    total = F.lit(0.0)
    for t in forest:
        total = total + tree(t)
    return total / F.lit(float(len(forest)))


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def findings(text: Column, forest: tuple | None = None) -> Column:
    """array<struct<token, before, score>>: every occurrence of a candidate with the forest's vote."""
    forest = forest or train_forest()
    text = F.coalesce(text.cast("string"), F.lit(""))

    def judged(token: Column, before: Column) -> Column:
        return let(
            F.struct(*[c.alias(k) for k, c in feature_columns(token, before).items()]),
            lambda row: F.struct(token.alias("token"), before.alias("before"), forest_column(forest, row).alias("score")),
        )

    def occurrences(gaps: Column, tokens: Column) -> Column:
        # what stands before a candidate: the gap, and as many candidates and gaps before it as CONTEXT can hold
        near = -(-CONTEXT // 12)

        def one(token: Column, i: Column) -> Column:
            first = F.greatest(i - near, F.lit(0))
            pieces = F.zip_with(F.slice(gaps, first + 1, i - first), F.slice(tokens, first + 1, i - first), lambda g, t: F.concat(F.right(g, F.lit(CONTEXT)), F.right(t, F.lit(CONTEXT))))
            whole = F.concat(F.array_join(pieces, ""), F.right(F.get(gaps, i), F.lit(CONTEXT)))
            return let(F.right(whole, F.lit(CONTEXT)), lambda before: let(F.regexp_replace(token, r"\.+$", ""), lambda t: judged(t, before)))

        return F.transform(tokens, one)

    # both read the same matches: the candidates, and the texts between them
    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda tokens: F.when(F.size(tokens) == 0, F.array().cast(FOUND)).otherwise(let(F.split(text, CANDIDATE, -1), lambda gaps: occurrences(gaps, tokens))))


FOUND = "array<struct<token:string,before:string,score:double>>"


GIVEN = "array<struct<head:string,value:string,score:double>>"


def judged_values(text: Column, pattern: str, threshold: float, forest: tuple) -> Column:
    """struct<text, given>: what the pattern proposes (group 2 after the head, group 1), judged, and the text with MASK for what counts."""

    def judged(head: Column, value: Column) -> Column:
        row = F.struct(*[c.alias(k) for k, c in assigned_columns(head, value).items()])
        return let(row, lambda r: F.struct(head.alias("head"), value.alias("value"), forest_column(forest, r, ASSIGNED_FEATURES).alias("score")))

    def joined(gaps: Column, given: Column) -> Column:
        shown = F.transform(given, lambda g, i: F.concat(F.get(gaps, i), g["head"], F.when(g["score"] >= threshold, F.lit(MASK)).otherwise(g["value"])))
        return F.struct(F.concat(F.array_join(shown, ""), F.get(gaps, F.size(given))).alias("text"), given.alias("given"))

    found = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    none = F.struct(text.alias("text"), F.array().cast(GIVEN).alias("given"))
    return F.when(text.rlike(pattern), let(F.zip_with(found(1), found(2), judged), lambda given: joined(F.split(text, pattern, -1), given))).otherwise(none)


def scan(docs: DataFrame, text: str = "text", threshold: float = 0.5, everywhere: int = EVERYWHERE) -> DataFrame:
    """Add n_candidates, n_secrets, secrets (sorted distinct tokens) and redacted (the text with MASK for each)."""
    forest, raw = train_assigned(), F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.withColumns({"__found": findings(F.col(text)), "__named": judged_values(raw, ASSIGNED, threshold, forest)})
    found = found.withColumn("__url", judged_values(F.col("__named.text"), IN_ADDRESS, threshold, forest))
    found = found.withColumn("__given", F.concat("__named.given", "__url.given"))
    over = lambda c, name: F.array_distinct(F.transform(F.filter(c, lambda x: x["score"] >= threshold), lambda x: x[name]))
    found = found.withColumns({"__tokens": over("__found", "token"), "__values": over("__given", "value")})
    every = F.array_union("__tokens", "__values")
    whole = F.filter(every, lambda s: ~F.exists(every, lambda t: (t != s) & F.contains(t, s)))
    anywhere = F.array_union("__tokens", F.filter("__values", lambda v: (F.length(v) >= everywhere) & v.rlike("[^A-Za-z]")))
    n = F.size(F.array_union(F.transform("__found", lambda x: x["token"]), F.transform("__given", lambda x: x["value"])))
    out = found.withColumns({"n_candidates": n.cast("long"), "secrets": F.array_sort(whole), "__anywhere": anywhere})
    longest_first = F.transform(F.array_sort(F.transform("__anywhere", lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda x: x["s"])
    masked = F.aggregate(longest_first, F.col("__url.text"), lambda acc, s: F.replace(acc, s, F.lit(MASK)))
    redacted = F.when(F.size("secrets") == 0, F.col(text)).otherwise(masked)
    return out.withColumns({"n_secrets": F.size("secrets").cast("long"), "redacted": redacted}).drop("__found", "__named", "__url", "__given", "__tokens", "__values", "__anywhere")


def op3_secret_scan(spark, sf_dir) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets_sha256 (of the sorted tokens, joined by a newline), redacted_sha256."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_candidates", "n_secrets", F.sha2(F.array_join("secrets", "\n"), 256).alias("secrets_sha256"), F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets in the texts give way to MASK; no document goes and every column stays, whatever its name."""
    columns = docs.columns
    at = columns.index("text")
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    found = scan(named, f"c{at}")
    return found.select(*[F.col("redacted" if k == at else f"c{k}").alias(c) for k, c in enumerate(columns)])
