"""Secret scan with a random forest that removes false positives.

Every whole text is cut into words; all tokens of a word are candidates, with
their neighbours. A token is a run of 12 or more letters, digits and ``+/_.-``
(any other character ends it, and so do HTML entities, percent escapes and
backslash escapes), a key of an issuer's form within such a run, the password of
a URL, or any value of ``SHORTEST`` or more characters that is assigned to a
credential name, in its word or in the words before. A forest then tells secrets from hashes without
context, numbers, paths and long words. Its features: length, shares of digits
and capitals, transitions between character classes, distinct characters, the
share of letter trigrams that the corpus's own dictionary knows, hex and
placeholder shapes, the document's path, and the neighbouring words (credential
names, assignment, quotes, plain prose behind).

It is trained from labelled findings. Without a table of them, they are made: the
corpus's candidates whose structure settles them (issuers' formats and values
assigned to credential names; numbers, prose words, paths), and a few hundred by
rule, so that both classes are always there. The sample is bounded: at most
``per_class`` distinct feature vectors of each class, by hash, and those made.

Only DataFrame operations and spark.ml run on the rows: no Python on executors.
Texts are never shuffled for the scan; letter trigrams (at most 17,576 of them)
are counted for the dictionary (``DICTIONARY`` trigrams, a literal set) with
map-side combining, and candidates are narrow rows.

Defined results: null and empty texts have no candidates; texts and tokens of
any length are taken whole; repeated rows give repeated findings; equal scores
need no order; a null doc_id is kept; an empty table gives an empty result;
extra columns are ignored by :func:`scan` and kept by :func:`redact`, unless
their names begin with ``_secret_``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerotally.plans.storage import materialise

DICTIONARY, PER_CLASS, TREES, DEPTH, SEED = 1500, 4000, 20, 6, 13
#: The most that equal findings count in training.
MOST_WEIGHT = 4
MASK = "[SECRET]"
_SPACE = r"[\x20\x09-\x0D]+"
_RUN = r"A-Za-z0-9+/_.\-"
#: A token: a whole run of these characters up to its last letter or digit, with base64 padding if nothing is assigned by it.
_TOKEN = rf"(?<![{_RUN}])[{_RUN}]{{11,}}[A-Za-z0-9](?:={{1,2}}(?![{_RUN}=\"'(<]))?"
#: What stands for another character, none of them of a token.
_ESCAPED = r"&(?:[A-Za-z]{2,8}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});|%[0-9A-Fa-f]{2}|\\(?:[nrt]|u[0-9A-Fa-f]{4})"
_QUOTES = r"&(?:quot|apos|#34|#39|#x22|#x27);|%22|%27|\\u002[27]"
#: The name that a value in the same word is assigned to.
_NAME = r"([A-Za-z_.\-][A-Za-z0-9_.\-]{0,99})[\"'`\\)\]]{0,4}(?:=>|[=:])[=\"'`\\(<\[{]{0,4}$"
_CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private|bearer)"
_PLACEHOLDER = r"(?i)(example|sample|your|placeholder|changeme|dummy|xxxx|0000|1234|^\$|\{|%\()"
#: What assigns a value within a word, and values: to a credential name, and in a URL.
_ASSIGNS = r"[A-Za-z0-9_.\-]{0,60}[\"'`\])]{0,3}(?:=>|:=|[=:])[\"'`(<\[{]{0,3}"
SHORTEST = 6
_VALUE = _CREDENTIAL + _ASSIGNS + r"([^\s\"'`<>,;&)\]}]{%d,})" % SHORTEST
_VALUE_GROUP = 3
_URL_PASSWORD = r"://[^/\s:@]*:([^\s/@]{3,})@"
_TRIM = r"^[\"'`(<\[{]*(.*?)[.,;:!?\"'`)>\]}]*$"
#: How issuers form their keys.
_ISSUED = (
    r"^(AKIA|ASIA)[A-Z0-9]{16}$",
    r"^gh[pousr]_[A-Za-z0-9]{36,}$",
    r"^xox[abprs]-[A-Za-z0-9\-]{10,}$",
    r"^sk_(live|test)_[A-Za-z0-9]{16,}$",
    r"^AIza[A-Za-z0-9_\-]{35}$",
    r"^eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+$",
)
#: The same within a longer run.
_ISSUED_WITHIN = "|".join(f"(?<![A-Za-z0-9]){p[1:-1]}(?![A-Za-z0-9])" for p in _ISSUED)
FEATURES = ("length", "digits", "capitals", "transitions", "distinct", "coverage", "hex", "placeholder", "path_code", "path_test", "named", "assigned", "in_quotes", "prose_next")


def tokens(word: Column, value: Column) -> Column:
    """All tokens of a word whose escapes are gone: keys of a fixed form within longer runs, values of credentials (``value`` is whether the whole word is one) and of URLs, then whole runs."""
    every = lambda pattern, group=0: F.regexp_extract_all(word, F.lit(pattern), F.lit(group))
    whole = F.regexp_extract(word, _TRIM, 1)
    short = F.when(value & (F.length(whole) >= SHORTEST) & ~word.contains("="), F.array(whole)).otherwise(F.array().cast("array<string>"))
    assigned = F.filter(every(_VALUE, _VALUE_GROUP), lambda v: ~v.rlike(r"^[^A-Za-z0-9]|^//"))
    return F.array_distinct(F.concat(every(_ISSUED_WITHIN), every(_URL_PASSWORD, 1), assigned, short, every(_TOKEN)))


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """``(doc_id, doc_key, path, at, token, name, before, behind, quoted)``: one row per candidate, ``at`` counts words from 0.

    A word may hold several; the neighbours of each are what stands beside it in
    the word, or else the words around.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.split(F.regexp_replace(body, f"^{_SPACE}", ""), _SPACE)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("long"), body).alias("doc_key"),
        (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"), words.alias("w"),
    )
    word = lambda i: F.get(F.col("w"), i)

    def value(i: Column) -> Column:
        """Whether the words before say that this one is a credential's value."""
        last = F.coalesce(word(i - 1), F.lit(""))
        assigns = F.substring(last, -1, 1).isin("=", ":", ">") | (F.lower(last) == "is")
        return (i > 0) & assigns & (last.rlike(_CREDENTIAL) | (F.length(last) <= 2) & F.coalesce(word(i - 2), F.lit("")).rlike(_CREDENTIAL))

    run = lambda w: (F.length(w) >= 12) & w.rlike(f"[{_RUN}]{{12}}") & (w.rlike("[0-9]") | (F.length(w) >= 20) | w.rlike(_CREDENTIAL))
    inside = lambda w: (F.length(w) > SHORTEST) & (w.contains("=") & w.rlike(_VALUE) | w.contains(":") & (w.rlike(_VALUE) | w.rlike(_URL_PASSWORD)))
    hits = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: run(word(i)) | inside(word(i)) | (F.length(word(i)) >= SHORTEST) & value(i))
    at = rows.withColumn("at", F.explode(F.when(F.size("w") > 0, hits).otherwise(F.array().cast("array<int>"))))
    before = F.lower(F.concat_ws(" ", F.when(F.col("at") > 1, word(F.col("at") - 2)), F.when(F.col("at") > 0, word(F.col("at") - 1))))
    own = F.regexp_replace(F.regexp_replace(word(F.col("at")), _QUOTES, '"'), _ESCAPED, " ")
    near = at.select(
        "doc_id", "doc_key", "path", "at", before.alias("before"), F.coalesce(word(F.col("at") + 1), F.lit("")).alias("behind"),
        F.explode(F.transform(F.array(F.struct(own.alias("word"), value(F.col("at")).alias("value"))), lambda o: F.struct(o.word.alias("word"), tokens(o.word, o.value).alias("tokens")))).alias("own"),
    )
    each = near.select("doc_id", "doc_key", "path", "at", "before", "behind", F.col("own.word").alias("word"), F.explode("own.tokens").alias("token"))
    left, right = F.expr("substring_index(word, token, 1)"), F.expr("substr(word, instr(word, token) + length(token))")
    parts = lambda c: F.filter(F.split(c, f"[^{_RUN}]+"), lambda x: x.rlike("[A-Za-z0-9]"))
    in_url = F.col("left").rlike("://[^/@]*:$") & F.col("right").startswith("@")
    name = F.when(in_url, "password").otherwise(F.lower(F.regexp_extract("left", _NAME, 1)))
    each = each.withColumn("left", left).withColumn("right", right).withColumn("name", name)
    ahead, next_ = parts(F.regexp_replace("left", _NAME, "")), parts(F.col("right"))
    return each.select(
        "doc_id", "doc_key", "path", "at", "token", "name",
        F.when(F.size(ahead) > 0, F.lower(F.concat_ws(" ", F.slice(ahead, F.greatest(F.size(ahead) - 1, F.lit(1)), 2)))).otherwise(F.col("before")).alias("before"),
        F.when(F.size(next_) > 0, F.get(next_, F.lit(0))).otherwise(F.col("behind")).alias("behind"),
        (F.col("left").rlike("[\"']$") | F.col("right").rlike("^[\"']")).alias("quoted"),
    )


def dictionary(docs: DataFrame, *, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The ``size`` most frequent trigrams of the letters a to z (within runs of them, lower-cased), over all documents."""
    parts = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?=([a-z]{3}))"), F.lit(1))).alias("part"))
    counted = parts.groupBy("part").agg(F.count("*").alias("n"))  # combined before the shuffle
    return [r["part"] for r in counted.orderBy(F.desc("n"), "part").limit(size).select("part").collect()]  # size strings of three letters


def described(found: DataFrame, parts: list[str]) -> DataFrame:
    """``found`` with a column for each of :data:`FEATURES` and ``settled`` (1 secret, 0 not, null open)."""
    token, n = F.col("token"), F.length("token").cast("double")
    count = lambda pattern: F.regexp_count(token, F.lit(pattern)).cast("double")
    letters = F.regexp_replace(F.lower(token), "[^a-z]", " ")
    known = lambda t: t.isin(parts or ["   "])
    coverage = sum(F.size(F.filter(F.regexp_extract_all(letters.substr(i, 1 << 30), F.lit(".{3}"), F.lit(0)), known)) for i in (1, 2, 3)) / F.greatest(n - 2, F.lit(1.0))
    changes = "(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"
    named = (F.col("name").rlike(_CREDENTIAL) | F.col("before").rlike(_CREDENTIAL)).cast("double")
    assigned = ((F.col("name") != "") | F.col("before").rlike(r"(=|:|=>|:=|\bis)$")).cast("double")
    path = F.lower(F.coalesce("path", F.lit("")))
    shapes = {
        "length": F.least(n, F.lit(200.0)), "digits": count("[0-9]") / n, "capitals": count("[A-Z]") / n, "transitions": count(changes) / n,
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / n, "coverage": coverage, "hex": token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "placeholder": token.rlike(_PLACEHOLDER).cast("double"), "path_code": path.rlike(r"\.(env|cfg|conf|ini|ya?ml|json|properties|pem|key|py|js|java|go|sh)$").cast("double"),
        "path_test": path.rlike("(test|example|fixture|sample|doc|lock|vendor)").cast("double"), "named": named, "assigned": assigned, "in_quotes": F.col("quoted").cast("double"),
        "prose_next": F.col("behind").rlike(r"^[A-Za-z\x{80}-\x{ffff}]+[.,;:!?]?$").cast("double"),
    }
    issued = F.lit(False)
    for pattern in _ISSUED:
        issued = issued | token.rlike(pattern)
    value = (named == 1) & (assigned == 1) & (count("[0-9]") >= 3) & (count("[A-Za-z]") >= 2) & ~token.rlike(_PLACEHOLDER)
    plain = token.rlike(r"^[0-9.,:/+\-]+$") | ((count("[0-9]") == 0) & (named == 0)) | token.rlike(r"^(?!.*\.\.)[a-z0-9\-][a-z0-9\-.]*\.(com|net|org|html?|php|jpg|png|pdf)(/[a-z_.\-/]*)?$") | (token.rlike(_PLACEHOLDER) & (count("[0-9]") / n < 0.4))
    return found.select("*", *[v.alias(k) for k, v in shapes.items()]).withColumn("settled", F.when(issued | value, 1).when(plain, 0).cast("int"))


def made_findings(spark: SparkSession, n: int = 400) -> DataFrame:
    """Findings of both classes by rule, as :func:`candidates` gives them, so that training never lacks a class."""
    i = F.col("id")
    random = F.sha2(i.cast("string"), 256)
    coded = F.regexp_replace(F.base64(F.unhex(random)), "[^A-Za-z0-9]", "x")
    pick = lambda *values: F.element_at(F.array(*values), (i % len(values) + 1).cast("int"))
    lit = F.lit
    short = F.concat(F.substring(coded, 1, 4), pick(lit("!"), lit("7"), lit("#"), lit("$"), lit("_")), F.substring(coded, 5, 5))
    wordy = F.concat(pick(lit("hunter"), lit("dragon"), lit("Summer"), lit("letmein")), F.substring(F.regexp_replace(random, "[^0-9]", ""), 1, 3))
    kinds = [  # token, name, before, quoted
        (F.substring(random, 1, 40), lit(""), lit("token ="), lit(True)),
        (F.substring(coded, 1, 32), lit("api_key"), lit("set"), lit(True)),
        (F.concat(lit("AKIA"), F.substring(F.upper(coded), 1, 16)), lit(""), lit("key id"), lit(False)),
        (F.substring(random, 1, 18), lit("password"), lit("the"), lit(False)),
        (short, lit("password"), lit("https admin"), lit(False)),
        (short, lit(""), lit("password ="), lit(False)),
        (wordy, lit("passwd"), lit("login"), lit(False)),
        (wordy, lit(""), lit("password is"), lit(False)),
    ]
    secret = spark.range(n).select(*[pick(*column).alias(c) for c, column in zip(("token", "name", "before", "quoted"), zip(*kinds))], pick(lit("and"), lit(""), lit("db.internal")).alias("behind"))
    plain = pick(lit("required"), lit("expired"), lit("protected"), lit("manager"), lit("incorrect"))
    others = [  # token, name, before
        (F.repeat(lit("nation"), 3), lit(""), lit("of the")),
        (F.format_string("%016d", i * 7919), lit(""), lit("number is")),
        (F.concat(lit("your_api_key_"), i.cast("string")), lit(""), lit("api_key =")),
        (F.concat(lit("2024-01-"), F.format_string("%02d", i % 28), lit("T00-00-00")), lit(""), lit("on")),
        (F.concat(lit("www.site-"), i.cast("string"), lit(".com"), pick(lit(""), lit("/about"), lit("/news/page"))), lit(""), lit("see")),
        (plain, lit(""), lit("password is")),
        (plain, lit(""), lit("authorization:")),
        (F.concat(lit("$"), lit("{DB_PASSWORD}")), lit("password"), lit("set")),
    ]
    false = spark.range(n).select(*[pick(*column).alias(c) for c, column in zip(("token", "name", "before"), zip(*others))], lit(False).alias("quoted"), lit("and").alias("behind"))
    rows = secret.withColumn("label", lit(1)).unionByName(false.withColumn("label", lit(0)))
    return rows.select(lit(None).cast("long").alias("doc_id"), lit(0).cast("long").alias("doc_key"), lit(None).cast("string").alias("path"), lit(0).alias("at"), "token", "name", "before", "behind", "quoted", "label")


@dataclass
class Scanner:
    """A trained forest and the dictionary its features use."""

    forest: Model
    parts: list[str]

    def judge(self, found: DataFrame) -> DataFrame:
        """``found`` (described candidates) with ``score`` and ``is_secret``."""
        scored = self.forest.transform(_vectors(found)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
        return scored.select(*found.columns, "score", (F.col("score") >= 0.5).alias("is_secret"))


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(found)


def train(labelled: DataFrame, parts: list[str], *, made: DataFrame | None = None, per_class: int = PER_CLASS) -> Scanner:
    """A forest from labelled findings (rows of :func:`candidates` with ``label``), a bounded sample of each class.

    The sample is drawn from distinct feature vectors, each with the number of
    its findings as weight (``MOST_WEIGHT`` at most); all of ``made`` come on top.
    """
    some = described(labelled, parts).groupBy("label", *FEATURES).agg(F.least(F.count("*"), F.lit(MOST_WEIGHT)).cast("double").alias("weight"))
    by_hash = [some.where(F.col("label") == v).orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(per_class) for v in (0, 1)]
    sample = by_hash[0].unionByName(by_hash[1])
    if made is not None:
        sample = sample.unionByName(described(made, parts).select("label", *FEATURES, F.lit(1.0).alias("weight")))
    sample = materialise(sample, "secret-sample")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return Scanner(forest.fit(_vectors(sample.withColumn("label", F.col("label").cast("double")))), parts)


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", findings: DataFrame | None = None) -> DataFrame:
    """Every candidate with its score and verdict: ``(doc_id, doc_key, at, token, score, is_secret)``.

    ``findings``: labelled findings to train from (the columns of
    :func:`candidates` and ``label``); without it they come from the corpus.
    """
    parts = dictionary(docs, text=text)
    found = materialise(described(candidates(docs, doc_id=doc_id, text=text, path=path), parts), "secret-candidates")
    made = made_findings(docs.sparkSession)
    columns = made.columns
    if findings is None:
        findings = found.where("settled is not null").withColumn("label", F.col("settled")).select(*columns)
    scanner = train(findings.select(*columns), parts, made=made)
    return scanner.judge(found).select("doc_id", "doc_key", "at", "token", "score", "is_secret")


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", **parameters) -> DataFrame:
    """``docs`` with every secret replaced by :data:`MASK` in the text, wherever it stands; all rows stay.

    Secrets are gathered by document (the texts of equal rows alike), and only
    those lists are joined to the texts. ``n_chars``, where there is such a
    column, follows the new text.
    """
    found = scan(docs, doc_id=doc_id, text=text, **parameters).where("is_secret")
    tokens_ = F.array_sort(F.collect_set("token"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    lists = found.groupBy("doc_id", "doc_key").agg(tokens_.alias("_secret_tokens"))  # longest first: one may hold another
    lists = materialise(lists, "secret-lists").select(F.col("doc_id").alias("_secret_id"), F.col("doc_key").alias("_secret_key"), "_secret_tokens")
    body = F.col(f"`{text}`")
    number = F.col(f"`{doc_id}`").cast("long")
    keyed = docs.withColumn("_secret_doc", F.xxhash64(number, F.coalesce(body, F.lit("")))).withColumn("_secret_number", number)
    joined = keyed.join(lists, (F.col("_secret_doc") == F.col("_secret_key")) & F.col("_secret_number").eqNullSafe(F.col("_secret_id")), "left")
    clean = F.when(F.col("_secret_tokens").isNull(), body).otherwise(F.aggregate("_secret_tokens", body, lambda t, s: F.replace(t, s, F.lit(MASK))))
    joined = joined.withColumn("_secret_text", clean)
    value = {text: F.col("_secret_text")}
    if n_chars and n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        value[n_chars] = F.when(F.col("_secret_tokens").isNull(), F.col(f"`{n_chars}`")).otherwise(F.length("_secret_text").cast(kind))
    return joined.select(*[value.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
