"""Secret scan with a random forest against false positives (operator 9).

Everything runs on column functions and Spark ML. One regular expression
finds candidates: key blocks, assignments to a secret's name, tokens of known
form, and long mixed strings. A key block runs from its BEGIN to its END line. Each candidate gets features: length, shares
and transitions of character classes, coverage by dictionary words, whether it
stands in a path, and neighbouring words that name or disown a secret. A
random forest trained on labelled findings decides.

Labelled findings come as a table (before, value, after, label), with the text
on both sides of the value. ``labelled_findings`` derives one from a corpus:
words of a bounded sample of its documents surround values of known kind,
real ones (keys, tokens, passwords of random characters) and lookalikes
(hashes of commits, checksums, ids in paths, placeholders, names with digits).

Defined cases: null and empty texts have no findings; rows that repeat an id
are scanned one by one, and their findings carry the same id; an empty table
gives an empty result. Extra columns are kept by ``redacted`` and otherwise
ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsframe.llm.common import fresh
from newsframe.session import written_table

NAMES = r"(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth[_-]?key|private[_-]?key)"
SIGN = r"(?::=|=>|==?|:)"
_NAMED = NAMES + r"[\w-]{0,64}+[\"']?\s*+" + SIGN
#: Kinds by first match; a value of an assignment follows its sign.
KINDS = {
    # to its END line, however long; the BEGIN line alone if another block comes first or none ends it
    "key_block": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
                 r"(?:(?>[\s\S]*?(?=-----(?:BEGIN|END) ))-----END [A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----)?",
    "assignment": _NAMED + r"\s*+(?:\"[^\"\n]++(?=\")|'[^'\n]++(?=')|[\"']?[^\s\"']++)",
    "cloud_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "service_token": r"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[0-9A-Za-z]{16,}",
    "signed_token": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*",
    # from a run's first letter or digit; with a digit anywhere, or of 20 letters and more
    "mixed": r"(?=[A-Za-z0-9][A-Za-z0-9+/_-]{15})(?<![A-Za-z0-9][+/_-]{0,8})(?=[A-Za-z+/_-]*+[0-9]|[A-Za-z]{20})(?![\w-]{0,64}?(?i:" + _NAMED
             + r"))[A-Za-z0-9][A-Za-z0-9+/_-]{15,}={0,2}",
}
_CASELESS = {"assignment"}
#: A name may end a longer identifier; the other kinds start after a letter or digit never.
CANDIDATE = "(?:" + "|".join(f"(?i:{p})" if k in _CASELESS else r"(?<![A-Za-z0-9])" + p if "|" not in p or k == "key_block"
                             else rf"(?<![A-Za-z0-9])(?:{p})" for k, p in KINDS.items()) + ")"
NEAR = 40               # characters of context on either side
SECRET_WORDS = NAMES[3:-1] + r"|secret|credential|bearer|auth|login|key"
OTHER_WORDS = (r"commit|revision|checksum|sha1|sha256|md5|digest|hash|uuid|id|ref|example|sample|dummy|test|placeholder|"
               r"file|page|version|build|invoice|order|tracking|phone|card")
DICTIONARY = (r"change|example|sample|dummy|test|your|here|placeholder|password|secret|token|server|version|release|"
              r"data|user|name|file|image|report|final|draft|update|window|system|number|order|project|value|default|"
              r"enter|insert|none|null|true|false|admin|demo|xxx+|the|and|ing|tion")
TRAIN_DOCS = 1_500      # documents whose words surround the derived labelled findings, at most (about)
TREES, DEPTH, SEED = 40, 10, 7
FLAG_AT = 0.5


# ------------------------------------------------------------ candidates

def _value(found: Column) -> Column:
    """The secret part of a candidate."""
    return F.when(_kind(found) == "assignment", F.regexp_extract(found, r"^[^:=]*" + SIGN + r"\s*[\"']?(.*)$", 1)).otherwise(found)


def _kind(found: Column) -> Column:
    out = None
    for k, p in KINDS.items():
        fits = found.rlike(f"^(?:{'(?i)' if k in _CASELESS else ''}{p})$" if k != "assignment" else f"^(?i:{p})")
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return out


def _found(text: str = "text") -> tuple[Column, Column]:
    """The candidates of a text, and the parts of the text around them."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def _key(text: str = "text") -> Column:
    """Tells apart rows that repeat an id with other texts."""
    return F.xxhash64(text)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, finding, start, length, kind, before, value, after): start
    and length (characters) of the value in the text."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.where(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    found, parts = _found()
    d = d.select("doc_id", "row", _key().alias("key"), found.alias("found"), parts.alias("parts"))
    # only what each candidate needs of the text goes on
    part = F.col("parts")
    d = d.select("doc_id", "row", "key", F.posexplode(F.transform("found", lambda m, i: F.struct(
        m.alias("found"), F.right(F.get(part, i), F.lit(NEAR)).alias("tail"),
        F.left(F.get(part, i + 1), F.lit(NEAR)).alias("after"),
        (F.length(F.get(part, i)) + F.length(m)).cast("long").alias("step")))).alias("finding", "x"))
    d = d.select("doc_id", "row", "key", "finding", "x.*", _value(F.col("x.found")).alias("value"),
                 _kind(F.col("x.found")).alias("kind"))
    to_here = Window.partitionBy("row").orderBy("finding").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("value").cast("long")
    before = F.concat("tail", F.left("found", F.length("found") - F.length("value")))
    return d.select("doc_id", "key", "finding", (F.sum("step").over(to_here) - length).alias("start"),
                    length.alias("length"), "kind", F.right(before, F.greatest(F.lit(NEAR), F.length("found") - F.length("value"))).alias("before"), "value", "after")


# ------------------------------------------------------------ features

def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds one column per feature of (before, value, after)."""
    v, low = F.col("value"), F.lower("value")
    size = F.greatest(F.length(v), F.lit(1))
    before, after = F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("after", F.lit("")))

    def share(pattern):
        return F.regexp_count(v, F.lit(pattern)) / size

    def flag(cond):
        return F.coalesce(cond, F.lit(False)).cast("double")

    chars = F.filter(F.split(v, ""), lambda c: c != "")
    cols = {
        "f_length": F.log1p(F.length(v)),
        "f_lower": share("[a-z]"), "f_upper": share("[A-Z]"), "f_digit": share("[0-9]"),
        "f_other": share("[^A-Za-z0-9]"),
        "f_distinct": F.size(F.array_distinct(chars)) / size,
        "f_hex": flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        # transitions between neighbouring characters
        "f_turns": share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"),
        "f_letter_digit": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "f_vowel_turns": share("(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])"),
        "f_repeats": share(r"(.)(?=\1)"),
        "f_dictionary": 1 - F.length(F.regexp_replace(low, DICTIONARY, "")) / size,
        # paths and neighbours
        "f_in_path": flag(before.rlike(r"[/.@\\-]$") | after.rlike(r"^[/.@\\]") | v.contains("/")),
        "f_url": flag(before.rlike(r"https?://\S*$")),
        "f_assigned": flag(before.rlike(SIGN + r"\s*[\"']?$")),
        "f_quoted": flag(before.rlike(r"[\"']$")),
        "f_secret_word": flag(before.rlike(f"(?:{SECRET_WORDS})")),
        "f_named": flag(before.rlike(_NAMED + r"\s*[\"']?$")),
        "f_other_word": flag(before.rlike(f"\\b(?:{OTHER_WORDS})\\b")),
        "f_key_block": flag(v.startswith("-----BEGIN")),
        "f_prefix": flag(v.rlike("^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|eyJ|-----BEGIN)")),
    }
    return found.withColumns({k: c.cast("double") for k, c in cols.items()}), list(cols)


# ------------------------------------------------------------ training

def labelled_findings(docs: DataFrame, max_docs: int = TRAIN_DOCS, n_docs: int | None = None) -> DataFrame:
    """(before, value, after, label) derived from a bounded sample of the
    documents: their first words surround values of known kind."""
    n = docs.count() if n_docs is None else n_docs
    keep = F.pmod(F.xxhash64("doc_id", F.lit("findings")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_docs / max(n, 1)))
    text = F.regexp_replace(F.substring(F.coalesce(F.col("text").cast("string"), F.lit("")), 1, 200), CANDIDATE, "")
    left, right = F.substring(text, 1, 60), F.substring(text, 61, 60)

    def rnd(salt):
        return F.sha2(F.concat_ws("-", F.lit(salt), F.xxhash64("doc_id", "text").cast("string")), 256)

    def b64(salt):
        return F.regexp_replace(F.base64(F.unhex(rnd(salt))), "[+/=]", "x")

    def letters(salt):
        return F.translate(F.left(b64(salt), F.lit(40)), "0123456789", "qZxKvjWgHR")

    word = F.regexp_extract(text, r"([A-Za-z]{4,})", 1)
    words = F.slice(F.regexp_extract_all(text, F.lit(r"([A-Za-z]{4,})"), F.lit(1)), 2, 5)
    secrets = [
        ('token = "', F.left(rnd("a"), F.lit(40)), '"'), ("password=", F.left(rnd("b"), F.lit(18)), ""),
        ("", F.concat(F.lit("AKIA"), F.upper(F.translate(F.left(b64("c"), F.lit(16)), "-_", "AB"))), ""),
        ("", F.concat(F.lit("ghp_"), F.left(b64("d"), F.lit(36))), ""),
        ("api_key: ", F.left(b64("e"), F.lit(32)), ""), ("secret='", F.left(b64("f"), F.lit(24)), "'"),
        ("password: ", F.left(b64("g"), F.lit(12)), ""), ("", F.lit("-----BEGIN RSA PRIVATE KEY-----"), ""),
        ("", F.left(b64("h"), F.lit(40)), ""),
        ("", F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.concat_ws("\n", *map(b64, "rstuvw")),
                      F.lit("\n-----END RSA PRIVATE KEY-----")), ""),
        ("", F.concat(F.lit("-----BEGIN PGP PRIVATE KEY BLOCK-----\n\n"), F.concat_ws("\n", *map(b64, "xyzABCDE")),
                      F.lit("\n-----END PGP PRIVATE KEY BLOCK-----")), ""),
        *((pre, F.concat(F.lit(f"-----BEGIN {kind}-----\n{head}"), F.concat_ws("\n", *map(rnd, salts)),
                         F.lit(f"\n-----END {kind}-----")), "")
          for pre, kind, head, salts in (("", "PGP PRIVATE KEY BLOCK", "Version: x\n\n", "OPQRSTUV"), ("key: ", "PRIVATE KEY", "", "WXYZ0123"))),
        ("password      = ", F.left(b64("F"), F.lit(8)), ""), ('secret => "', F.left(b64("G"), F.lit(10)), '"'),
        ("dbpassword=", F.left(b64("H"), F.lit(9)), ""), ("userPassword: ", F.left(b64("I"), F.lit(10)), ""),
        ("", letters("J"), ""), ("key ", F.lower(letters("K")), ""), ("password=", F.left(b64("L"), F.lit(5)), ""),
        ('password = "', F.concat_ws(" ", word, F.left(b64("M"), F.lit(7))), '"'),
        ("Bearer ", F.concat(F.lit("eyJ"), F.left(b64("i"), F.lit(24)), F.lit("."), F.left(b64("j"), F.lit(30))), ""),
    ]
    others = [
        ("commit ", F.left(rnd("k"), F.lit(40)), ""), ("sha256: ", rnd("l"), ""), ("checksum ", F.left(rnd("m"), F.lit(32)), ""),
        ("https://www.example.com/", F.left(rnd("n"), F.lit(24)), "/index.html"),
        ("/static/img/", F.left(rnd("o"), F.lit(20)), ".png"),
        ("password=", F.lit("changeme123"), ""), ('token = "', F.lit("your_token_here_0"), '"'),
        ("api_key: ", F.lit("xxxxxxxxxxxxxxxx0"), ""),
        ("", F.concat(word, F.lit("version"), F.lit("2000release")), ""), ("", F.concat(F.lit("report_final_"), word, F.lit("_2024")), ""),
        ("order ", F.concat(F.lit("4"), F.translate(F.left(rnd("p"), F.lit(17)), "abcdef", "123456")), ""),
        ("id ", F.concat_ws("-", F.left(rnd("q"), F.lit(8)), F.substring(rnd("q"), 9, 4), F.substring(rnd("q"), 13, 12)), ""),
        ("", F.array_join(words, ""), ""), ("", F.initcap(F.array_join(words, "")), ""), ("", F.array_join(F.transform(words, F.initcap), ""), ""),
        ("token: ", word, ""), ("secretary: ", F.initcap(word), ""), ("secret: ", F.left(word, F.lit(3)), ""),
        ('secret: "', F.array_join(words, " "), '"'), ("tokens: ", F.translate(F.left(rnd("N"), F.lit(3)), "abcdef", "123456"), ""),
        ("token: ", F.concat(word, F.lit("value")), ""), ("password is ", F.concat(word, F.lit("example1")), ""),
    ]
    cases = [F.struct(F.concat(left, F.lit(" " + pre)).alias("before"), value.alias("value"),
                      F.concat(F.lit(post + " "), right).alias("after"), F.lit(label).alias("label"))
             for label, group in ((1.0, secrets), (0.0, others)) for pre, value, post in group]
    return docs.where(keep).select(F.explode(F.array(*cases)).alias("x")).select("x.*")


def train(findings: DataFrame, seed: int = SEED) -> RandomForestClassificationModel:
    """The forest fitted on labelled findings."""
    rows, names = features(findings)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, labelCol="label", featuresCol="features")
    return forest.fit(vectors)


# ------------------------------------------------------------ scan

def scored(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """The candidates with score and is_secret."""
    found = written_table(candidates(docs), "secret-candidates")
    if findings is None:
        findings = labelled_findings(docs)
    findings = written_table(findings, "secret-labelled")
    if findings.isEmpty():
        return found.withColumns({"score": F.lit(1.0), "is_secret": F.lit(True)})
    model = train(findings)
    model.setProbabilityCol("prob").setRawPredictionCol("").setPredictionCol("")
    rows, names = features(found)
    rows = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(rows)
    score = vector_to_array("prob")[1]
    return (model.transform(rows).select(*found.columns, score.alias("score"))
                 .withColumn("is_secret", F.col("score") >= FLAG_AT))


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, finding, start, length, kind, value, score, is_secret) per
    candidate of every whole text. Without labelled findings, those derived
    from ``docs`` train the forest."""
    return scored(docs, findings).select("doc_id", "finding", "start", "length", "kind", "value", "score", "is_secret")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every confirmed secret replaced in the texts. Documents
    without candidates are passed on as they are; only the others are joined
    with their findings."""
    n_id, n_key, n_flags, n_found, n_parts = (fresh(x, docs) for x in ("id_", "key_", "flags_", "found_", "parts_"))
    flags = (scored(docs).groupBy(F.col("doc_id").alias(n_id), F.col("key").alias(n_key))
             .agg(F.array_sort(F.collect_set(F.struct("finding", "is_secret"))).alias(n_flags),
                  F.bool_or("is_secret").alias("any")).where("any").drop("any"))
    flags = written_table(flags, "secret-flags")
    text = F.col("text").cast("string")
    some = F.coalesce(text.rlike(CANDIDATE), F.lit(False))
    same = F.col("doc_id").eqNullSafe(F.col(n_id)) & (F.xxhash64(text) == F.col(n_key))
    hit = docs.where(some).join(flags, same, "left")
    found, parts = _found()
    hit = hit.withColumns({n_found: F.when(F.col(n_flags).isNotNull(), found), n_parts: parts})
    shown = F.transform(n_found, lambda m, i: F.concat(F.get(F.col(n_parts), i), F.when(
        F.get(F.col(n_flags), i)["is_secret"], F.concat(F.left(m, F.length(m) - F.length(_value(m))), F.lit(mark)))
        .otherwise(m)))
    clean = F.concat(F.array_join(shown, ""), F.element_at(n_parts, -1))
    hit = hit.withColumn("text", F.coalesce(clean, F.col("text")))
    return docs.where(~some).unionByName(hit.select(*docs.columns))
