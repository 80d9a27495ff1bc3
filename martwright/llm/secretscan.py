"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are looked for in white-space separated words, by shape and by place. By shape: a run of at
least 16 key characters with a digit among them. By place: whatever of 6 characters or more is assigned to a
word that asks for a secret (``password = ...``, ``api_key:"..."``, ``Bearer ...``), with any punctuation, and the
password of an address (``scheme://user:password@host``). The forest sees its length, its character transitions (changes between kinds
of characters, vowels after consonants), how much of it dictionary words cover, the path it comes from and
the words next to it. It is trained from labelled findings (value, before, after,
path, label), a bounded number of rows; it is small and goes to the executors whole.

Defined results: null and empty texts have no findings; a null path has no path features; repeated
rows repeat their findings; an empty table gives an empty table; other columns of the input are left out
of the findings and kept by ``redact``. Texts are read whole; only texts with a candidate are
split into words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import cut_lineage, document_keys, let

CANDIDATE = r"(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{16,}"

# Words that cover parts of harmless strings.
DICTIONARY = (
    "example sample test dummy fake placeholder change changeme insert your here goes none null"
    " todo xxx abc key token secret password value string data user name file path version build"
    " release config index page image style script module class type the and for with from this"
    " that not you are was will have http https www com org net html json"
).split()
ASKS = r"(?i)token|secret|passw|api.?key|access.?key|auth|bearer|credential|private|signature"
# A word that asks, as far as what it is set to; the value itself, without quotes and closing marks.
_SET = rf"(?:{ASKS})[\w.-]{{0,20}}[\"'`\])]{{0,2}}\s?(?:=>|:=|=|:)"
_VALUE = r"[\"'`]{0,2}((?!(?i:bearer))[^\s\"'`]{5,}[^\s\"'`;,.:)\]}])"
ASSIGNED = _SET + _VALUE  # within a word
AWAITED = rf"(?:{_SET}|(?i)bearer)$"  # the words before
FIRST = rf"^(?:=>|:=|=|:)?{_VALUE}"  # the word after them
ADDRESS = r"://[^\s/:@]{1,64}:([^\s/@]{3,})@"
# What every text with a candidate holds.
GATE = rf"{CANDIDATE}|{ADDRESS}|(?:{_SET}|(?i)bearer)\s*\S{{6}}|(?:{ASKS})[\w.-]{{0,20}}[\"'`\])]{{0,2}}\s[=:]"
TELLS = r"(?i)commit|sha.?\d|md5|checksum|digest|hash|uuid|guid|revision|integrity|etag|order|card"
PLACES = r"(?i)test|example|sample|doc|fixture|mock|spec"

FEATURES = (
    "length digits uppers lowers symbols hex_only turns case_turns vowel_turns distinct words"
    " quoted assigned asks tells asks_after path_test path_length"
).split()


def features(findings: DataFrame) -> DataFrame:
    """Adds FEATURES to (value, word, before, after, path)."""
    value, n = F.col("value"), F.length("value").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / n

    covered = F.regexp_replace(F.lower(value), "|".join(sorted(DICTIONARY, key=len)[::-1]), "")
    near = F.concat_ws(" ", F.col("before"), F.col("word"))
    head = F.substr("word", F.lit(1), F.position("value", "word") - 1)
    made = {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "hex_only": F.regexp_like(value, F.lit("^([0-9a-f]+|[0-9A-F]+)$")).cast("double"),
        "turns": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[A-Za-z0-9])[^A-Za-z0-9]"),
        "case_turns": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "vowel_turns": share("(?i)(?<=[bcdfghjklmnpqrstvwxyz])[aeiou]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "words": 1 - F.length(covered) / n,
        "quoted": F.regexp_like(head, F.lit("[\"'`]$")).cast("double"),
        "assigned": F.regexp_like(
            F.concat_ws(" ", F.col("before"), head), F.lit("[=:]\\s*[\"'`]?$")
        ).cast("double"),
        "asks": F.regexp_like(near, F.lit(ASKS)).cast("double"),
        "tells": F.regexp_like(near, F.lit(TELLS)).cast("double"),
        "asks_after": F.regexp_like("after", F.lit(ASKS)).cast("double"),
        "path_test": F.regexp_like("path", F.lit(PLACES)).cast("double"),
        "path_length": F.length("path").cast("double"),
    }
    return findings.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in made.items()})


def _vectors(findings: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        features(findings)
    )


def fit(findings: DataFrame, *, trees: int = 24, depth: int = 7, seed: int = 42):
    """A forest from labelled findings (value, word, before, after, path, label)."""
    rows = cut_lineage(_vectors(findings).select("features", "label", "value", "before"))
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features"
    ).fit(rows.coalesce(1).sortWithinPartitions("value", "before").select("features", "label"))


def _values(word: Column, before: Column) -> Column:
    """Candidates of a word: by place, then by shape those that are in none of them."""
    nothing = F.array().cast("array<string>")
    assigned = F.regexp_extract_all(word, F.lit(ASSIGNED), F.lit(1))
    awaited = F.when(
        F.regexp_like(before, F.lit(AWAITED)), F.regexp_extract_all(word, F.lit(FIRST), F.lit(1))
    ).otherwise(nothing)
    address = F.regexp_extract_all(word, F.lit(ADDRESS), F.lit(1))
    placed = F.array_distinct(F.concat(assigned, awaited, address))
    shaped = F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0))
    return let(
        placed,
        lambda p: F.concat(
            p, F.filter(F.array_distinct(shaped), lambda v: ~F.exists(p, lambda x: F.contains(x, v)))
        ),
    )


def candidates(text: Column) -> Column:
    """All (word_no, word, value, before, after) of a text, null without any."""

    def found(words: Column) -> Column:
        def of(i: Column) -> Column:
            word = F.element_at(words, i)
            before = F.concat_ws(" ", F.get(words, i - 4), F.get(words, i - 3), F.get(words, i - 2))
            return let(
                before,
                lambda b: F.transform(
                    _values(word, b),
                    lambda v: F.struct(
                        (i - 1).alias("word_no"),
                        word.alias("word"),
                        v.alias("value"),
                        b.alias("before"),
                        F.coalesce(F.get(words, i), F.lit("")).alias("after"),
                    ),
                ),
            )

        # A first look at each word alone leaves most of them.
        may = F.filter(
            F.sequence(F.lit(1), F.size(words)),
            lambda i: F.regexp_like(F.element_at(words, i), F.lit(f"{CANDIDATE}|{ADDRESS}|{_SET}"))
            | F.regexp_like(F.coalesce(F.get(words, i - 2), F.lit("")), F.lit("[=:]>?$|(?i)bearer$")),
        )
        return F.flatten(F.transform(may, of))

    return F.when(F.regexp_like(text, F.lit(GATE)), let(F.split(text, r"\s+"), found))


def scan(
    docs: DataFrame,
    model: RandomForestClassificationModel,
    *,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
) -> DataFrame:
    """One row per candidate: id, k1, k2, word_no, value, score, is_secret."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        *document_keys(F.col(id_col), F.col(text_col), docs.schema[id_col].dataType),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.explode(candidates(F.col(text_col))).alias("c"),
    ).select("id", "k1", "k2", "path", "c.*")
    scored = model.transform(_vectors(rows)).withColumn(
        "score", vector_to_array("probability")[1]
    )
    return scored.select(
        F.col("id").alias(id_col),
        "k1",
        "k2",
        "word_no",
        "value",
        "score",
        (F.col("score") >= threshold).alias("is_secret"),
    )


def redact(
    docs: DataFrame,
    model: RandomForestClassificationModel,
    *,
    mark: str = "[SECRET]",
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
    length_col: str = "n_chars",
) -> DataFrame:
    """All rows and columns of ``docs`` with the secrets in the texts replaced by ``mark``.

    Texts without a candidate pass straight through; the others, few of them,
    meet their findings by key. A recorded length is set anew where the text has changed.
    """
    may = F.coalesce(F.regexp_like(F.col(text_col), F.lit(GATE)), F.lit(False))
    secrets = (
        scan(docs.where(may), model, id_col=id_col, text_col=text_col, path_col=path_col)
        .where("is_secret")
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set("value"), asc=False).alias("secret_values"))
    )
    secrets = cut_lineage(secrets)
    packed = docs.where(may).select(
        F.struct(*docs.columns).alias("row"),
        *document_keys(F.col(id_col), F.col(text_col), docs.schema[id_col].dataType),
    )
    text = F.col("row")[text_col]
    clean = F.aggregate(
        F.coalesce("secret_values", F.array().cast("array<string>")),
        text,
        lambda t, v: F.replace(t, v, F.lit(mark)),
    )
    fields = []
    for name in docs.columns:
        field = F.col("row")[name]
        if name == text_col:
            field = clean
        elif name == length_col:
            size = F.length(clean).cast(docs.schema[name].dataType)
            field = F.when(F.col("secret_values").isNotNull(), size).otherwise(field)
        fields.append(field.alias(name))
    joined = packed.join(secrets, ["k1", "k2"], "left").select(*fields)
    return docs.where(~may).unionByName(joined)


def _chosen(docs: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """(w1, w2, path, h): words and source of about ``max_rows`` documents and of one empty one."""
    share = max_rows / max(docs.count(), 1)
    chosen = docs
    if share < 1:
        draw = F.xxhash64(F.lit(seed), "doc_id")
        chosen = docs.where(draw < F.lit(int((2 * share - 1) * 2.0**62) * 2))
    tokens = F.split(F.coalesce("text", F.lit("")), r"\s+")
    blank = docs.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("doc_id"),
        F.lit("").alias("text"),
        F.lit("").alias("source"),
    )
    chosen = chosen.select(F.col("doc_id").cast("string"), "text", "source").union(blank)
    drawn = chosen.select(
        F.get(tokens, F.lit(0)).alias("w1"),
        F.coalesce(F.get(tokens, F.lit(1)), F.lit("")).alias("w2"),
        F.coalesce("source", F.lit("")).alias("path"),
        F.sha2(F.concat_ws("#", F.lit(str(seed)), "doc_id"), 256).alias("h"),
    )
    more = [F.sha2(F.concat("h", F.lit(f"/{i}")), 512) for i in range(POOL)]
    bare = F.regexp_replace(F.translate(F.col("w1"), "0123456789", ""), r"[^\w]", "")
    # Written once: the kinds below only cut pieces out of these columns.
    return cut_lineage(
        drawn.select(
            "*",
            F.translate(F.concat(*(F.base64(F.unhex(m)) for m in more)), "+/=\r\n", "xyz").alias("pool"),
            F.substring(F.translate("h", "abcdef", ""), 1, 16).alias("digits"),
            bare.alias("letters"),
        )
    )


POOL = 8  # digests whose letters and digits a document lends


# Words that ask for a secret as programs write them, and what may stand around a value.
ASKING = (
    "token =", "TOKEN =", "api_key:", "api-key =", "secret =", "client_secret:", "access_key =", "auth_token =",
    "password =", "Password:", "credentials:", "private_key =",
)
QUOTES = ("", "", '"', "'", "`")
TAILS = ("", "", "", ",", ";", ")", ".", "]", "\\n", "!!", "...")
# What stands where a secret would, but is none.
STANDINS = (
    "changeme", "<password>", "<your-token>", "${TOKEN}", "$API_KEY", "********", "xxxxxxxx", "undefined", "string",
    "required", "optional", "process.env.TOKEN", "os.environ['TOKEN']", "getToken()", "self.password", "redacted",
    "[REDACTED]", "None,None", "example-password", "your_token_here", "insert-key-here", "placeholder",
)


def made_findings(
    docs: DataFrame,
    *,
    max_rows: int = 500,
    seed: int = 42,
    without: tuple[str, ...] = (),
) -> DataFrame:
    """Labelled findings for training, made from at most about ``max_rows`` documents.

    Each chosen document lends two of its own words as neighbours and its source as path to one finding of every
    kind below but those in ``without``, and one empty document always does; values come from digests of
    its id, and quotes, closing marks and asking words are drawn for each finding. Kinds with label 1 are keys as
    programs issue them, by shape or after a word that asks, and passwords; kinds with label 0 are what a
    pattern takes for them: digests, identifiers, numbers, placeholders, prose, long words.
    """
    base = _chosen(docs, max_rows, seed)
    h = F.col("h")

    def pick(options, salt: int) -> Column:
        at = F.pmod(F.xxhash64(F.lit(salt), h), F.lit(len(options))) + 1
        return F.element_at(F.array(*(F.lit(o) for o in options)), at.cast("int"))

    def key(salt: int, n: int) -> Column:
        """Letters of both cases and digits, from a place of the pool."""
        return F.substring("pool", 1 + 37 * salt % (86 * POOL - 80), n)

    letters, digits = F.col("letters"), F.col("digits")
    word = F.rpad(F.lower(letters), 6, "somewhat")
    few = F.substring(digits, 1, 2)
    dash = F.concat_ws(
        "-", *(F.substring(h, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    )
    mark = pick("!@#$%&*?-_", 1)
    short = F.concat(F.initcap(F.substring(word, 1, 5)), mark, few, key(2, 2))
    spelled = F.translate(F.substring(F.concat(word, word), 1, 9), "aeiost", "4310$7")
    mixed = F.concat(key(3, 4), mark, key(4, 4), pick("!@#$%&*?", 5))
    plain = F.translate(key(6, 28), "0123456789", "qWxZjKvPbG")
    wide = key(7, 64)

    def asked(label: int, name: str, value: Column) -> Column:
        """After a word that asks, with drawn quotes and closing marks."""
        quote = pick(QUOTES, len(name) + 11)
        return kind(label, name, value, pick(ASKING, len(name) + 12), quote, F.concat(quote, pick(TAILS, len(name) + 13)))

    def kind(label: int, name: str, value: Column, before, left="", right="") -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        near = F.concat_ws(" ", "w1", F.when(as_column(before) != "", as_column(before)).otherwise(F.col("w2")))
        return F.struct(
            F.lit(name).alias("kind"),
            value.alias("value"),
            F.concat(as_column(left), value, as_column(right)).alias("word"),
            near.alias("before"),
            F.col("w2").alias("after"),
            F.col("path"),
            F.lit(float(label)).alias("label"),
        )

    tail = pick(TAILS, 14)
    kinds = {
        "hex": asked(1, "hex", F.substring(h, 1, 40)),
        "upper hex": asked(1, "upper hex", F.upper(F.substring(h, 1, 40))),
        "half hex": asked(1, "half hex", F.substring(h, 5, 32)),
        "long key": asked(1, "long key", key(9, 40)),
        "middle key": asked(1, "middle key", key(10, 24)),
        "letters": asked(1, "letters", plain),
        "bearer": kind(1, "bearer", key(11, 36), "Authorization: Bearer"),
        "in a word": kind(1, "in a word", key(12, 32), "", F.concat(pick(("access_key='", "token=\"", "api_key:'"), 15)), "'"),
        "cloud": asked(1, "cloud", F.concat(F.lit("AKIA"), F.upper(key(13, 16)))),
        "bare cloud": kind(1, "bare cloud", F.concat(F.lit("AKIA"), F.upper(key(14, 16))), "", "", tail),
        "forge": asked(1, "forge", F.concat(F.lit("ghp_"), key(15, 36))),
        "chat": asked(1, "chat", F.concat(F.lit("xoxb-"), F.substring(digits, 1, 11), F.lit("-"), key(16, 24))),
        "payment": asked(1, "payment", F.concat(F.lit("sk_live_"), key(17, 24))),
        "maps": asked(1, "maps", F.concat(F.lit("AIza"), key(18, 35))),
        "block": kind(1, "block", wide, "BEGIN PRIVATE KEY-----"),
        "short password": asked(1, "short password", short),
        "spelled password": asked(1, "spelled password", spelled),
        "mixed password": asked(1, "mixed password", mixed),
        "address": kind(1, "address", mixed, "", F.lit("postgres://app:"), F.lit("@db.host/main")),
        "commit": kind(0, "commit", F.substring(h, 1, 40), "commit"),
        "digest": kind(0, "digest", h, "sha256:"),
        "checksum": kind(0, "checksum", F.md5(h), "checksum =", pick(QUOTES, 16)),
        "uuid": kind(0, "uuid", dash, pick(("uuid =", "id:", "request", "guid ="), 17)),
        "number": kind(0, "number", digits, "", pick(QUOTES, 18), tail),
        "named number": kind(0, "named number", digits, pick(("token", "order", "card", "call", "account"), 19), "", tail),
        "stand-in": asked(0, "stand-in", pick(STANDINS, 20)),
        "numbered stand-in": asked(0, "numbered stand-in", F.concat(F.lit("your_token_goes_here_"), few)),
        "crossed out": asked(0, "crossed out", F.concat(F.lit("xxxxxxxxxxxxxxxxxxxx"), few)),
        "example": asked(0, "example", F.concat(F.lit("example-password-"), few)),
        "prose": kind(0, "prose", word, pick(("password:", "the token:", "auth:", "private:", "signature:"), 21), "", tail),
        "capital prose": kind(0, "capital prose", F.initcap(word), pick(("Password:", "Credentials:", "Private:"), 22)),
        "call": kind(0, "call", F.concat(F.lit("get"), F.initcap(word), F.lit("()")), pick(ASKING, 23), "", pick((";", ",", ""), 24)),
        "long word": kind(0, "long word", F.concat(F.repeat(letters, 5), F.substring(digits, 1, 1)), ""),
        "path": kind(0, "path", F.concat(F.lit("assets/build/release-"), F.substring(digits, 1, 6)), "path"),
        "page": kind(0, "page", F.concat_ws("/", F.lit("docs"), word, F.lit("page"), digits), "see"),
    }
    wanted = [k for name, k in kinds.items() if name not in without]
    # A few at a time: one array of all kinds is more code than a generated method holds.
    parts = [
        base.select(F.explode(F.array(*wanted[i : i + 9])).alias("f")).select("f.*")
        for i in range(0, len(wanted), 9)
    ]
    return reduce(DataFrame.unionByName, parts).where(F.length("value") >= 6)
