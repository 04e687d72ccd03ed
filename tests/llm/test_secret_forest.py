import hashlib
import random
import string

from aerotally.llm import secret_forest as sf


def h(i, n=40):
    return hashlib.sha1(str(i).encode()).hexdigest()[:n]


def corpus():
    prose = "The nation and the station in the thereafter of counterrevolutionaries is not interesting. "
    docs = [(i, prose * 3) for i in range(40)]
    docs += [(100 + i, f'{prose} token = "{h(i)}" {prose}') for i in range(30)]
    docs += [(200 + i, f"{prose} password={h(i, 18)} {prose}") for i in range(30)]
    docs += [(300 + i, f"{prose} AKIA{h(i, 16).upper().translate(str.maketrans('0189', 'GHJK'))} {prose}") for i in range(30)]
    docs += [(400 + i, f"{prose} 59272430742733{i:02d} call +1 (136) 555-7479 mail an.90@mail2.example.com at 169.122.221.182 {prose}") for i in range(30)]
    docs += [(500, None), (501, ""), (502, "   "), (503, "supercalifragilisticexpialidocious and internationalization of www.some-site-12.com/page"), (504, ("x" * 70000) + " 1"), (None, f'secret: "{h(77)}"')]
    return docs + [docs[45], docs[45]]


def test_finds_secrets_and_leaves_the_rest(spark):
    df = spark.createDataFrame([(i, t, f"src{0 if i is None else i % 3}", 0.5, "x") for i, t in corpus()], "doc_id long, text string, source string, score double, token string").repartition(3)
    got = [r for r in sf.scan(df).collect() if r.is_secret]
    ids = {r.doc_id for r in got}
    assert {i for i, _ in corpus() if i is not None and 100 <= i < 400} | {None} <= ids
    assert not any(i is not None and (i < 100 or i >= 400) for i in ids)
    assert sum(r.doc_id == 105 for r in got) == 3


def test_redact_keeps_rows_and_columns(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "src", len(t or ""), "m") for i, t in docs], "doc_id long, text string, source string, n_chars long, _x string")
    out = sf.redact(df)
    assert out.columns == df.columns and out.count() == len(docs)
    by = {r.doc_id: r for r in out.collect()}
    assert sf.MASK in by[110].text and h(10) not in by[110].text and by[110].n_chars == len(by[110].text)
    assert by[3].text == docs[3][1] and by[500].text is None and by[410].text == dict(docs)[410]


def test_trains_from_given_findings(spark):
    df = spark.createDataFrame([(1, f"commit {h(1)} done"), (2, f"commit {h(2)} done")], "doc_id long, text string")
    made = sf.made_findings(spark)
    extra = made.where("label = 1").withColumn("before", sf.F.lit("a commit")).withColumn("name", sf.F.lit("")).withColumn("label", sf.F.lit(0)).withColumn("token", sf.F.sha1(sf.F.col("token"))).withColumn("quoted", sf.F.lit(False)).withColumn("behind", sf.F.lit("done"))
    got = sf.scan(df, path=None, findings=extra.unionByName(made).unionByName(extra)).collect()
    assert len(got) == 2 and not any(r.is_secret for r in got)


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    out = sf.scan(df)
    assert out.count() == 0 and sf.redact(df).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_token_of_a_word_is_a_candidate(spark):
    aws, live, hub, hexa = "AKIA" + "GHJKLMNP2345QRST", "sk_live_" + "a1B2c3D4e5F6g7H8", "ghp_" + "a1B2" * 9, h(5)
    texts = [
        f'{{"aws":"{aws}","region":"eu-west-1"}}', f"token={aws},user=bob", f"/cb?token={live}&u=1", f"https://u:{hub}@github.com/x", f"`{hub}`", f"[{aws}]", f"{{{aws}}}", f"<td>{aws}</td>",
        f"密钥{aws}", f"&quot;{hexa}&quot;", f"a=&#39;{hexa}&#39;;b=&#39;{aws}&#39;", f"%22{aws}%22", f"/v1/{aws}/x", f"key\\n{aws}\\n",
    ]
    long = h(6) * 150
    df = spark.createDataFrame(list(enumerate([*texts, f"data {long}"])), "doc_id long, text string")
    got = {(r.doc_id, r.token): r for r in sf.candidates(df, path=None).collect()}
    for i, t in enumerate(texts):
        assert [k for k in (aws, live, hub, hexa) if k in t] == [k for k in (aws, live, hub, hexa) if (i, k) in got], t
    assert (len(texts), long) in got
    assert got[0, aws].name == "aws" and got[0, aws].quoted and got[0, aws].behind == "region" and got[1, aws].name == "token"
    out = {r.doc_id: r.text for r in sf.redact(df, path=None, n_chars=None).collect()}
    assert all(k not in out[i] for i in range(len(texts)) for k in (aws, live, hub))


def test_padding_belongs_to_values_only(spark):
    df = spark.createDataFrame([(1, "AWS_SECRET_ACCESS_KEY=abcdefghij0123456789== end")], "doc_id long, text string")
    assert {r.token for r in sf.candidates(df, path=None).collect()} == {"AWS_SECRET_ACCESS_KEY", "abcdefghij0123456789=="}


def test_values_of_credentials_are_candidates_at_any_length(spark):
    texts = {
        "password=hunter2": "hunter2", "the password is hunter2.": "hunter2", 'passwd = "hunter2"': "hunter2", "https://user:Pa55wordSecret@host/x": "Pa55wordSecret",
        "password=S3cr!et#Pass$word9": "S3cr!et#Pass$word9", '{"pwd":"s3cr!t","x":1}': "s3cr!t", "auth_token: abc123,": "abc123", f"data {'k1' * 2400}": "k1" * 2400,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.token) for r in sf.candidates(df, path=None).collect()}
    assert [t for i, t in enumerate(texts.values()) if (i, t) not in got] == []


PROSE = "The nation and the station in the thereafter of counterrevolutionaries is not interesting. "


def planted():
    """(kind, whether secret, text) of made secrets and of things that look like them, none of the kinds in the made findings' exact form."""
    r = random.Random(8)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    alnum, up, hexa = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
    words = ["station", "counter", "monitor", "visitor", "gardens"]
    for _ in range(25):
        yield "hex token", True, f'token = "{some(hexa, 40)}"'
        yield "api key", True, f"export API_KEY={some(alnum, 28)}"
        yield "aws", True, f"id AKIA{some(up, 16)} here"
        yield "json secret", True, f'{{"client_secret":"{some(alnum, 24)}","n":1}}'
        yield "url password", True, f"postgres://app:{some(alnum, 5)}7{some(alnum, 6)}@db.internal/x"
        yield "short password", True, f"password={r.choice(words)}{r.randint(10, 999)}"
        yield "symbol password", True, f"password: {some(alnum, 4)}!{some(alnum, 3)}#{r.randint(1, 9)}"
        yield "long number", False, f"call {some('0123456789', 14)} now"
        yield "prose", False, f"the password is {r.choice(['required', 'mandatory', 'confidential', 'forgotten'])} for all"
        yield "path", False, f"see www.{some('abcdefgh', 8)}-{r.randint(1, 99)}.com/page.html for it"
        yield "template", False, "password=${DB_PASSWORD} and more"
        yield "date", False, f"on 20{r.randint(10, 24)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T12-30-05 it"
        yield "word", False, f"{r.choice(words)}-{r.choice(words)}-{r.choice(words)} is a place"


def test_recall_and_false_positives_by_kind(spark):
    rows = list(planted())
    df = spark.createDataFrame([(i, f"{PROSE}{t} {PROSE}") for i, (_, _, t) in enumerate(rows)], "doc_id long, text string").repartition(3)
    hit = {r.doc_id for r in sf.scan(df, path=None).where("is_secret").collect()}
    shares = {k: sum(i in hit for i, r in enumerate(rows) if r[0] == k) / 25 for k, _, _ in rows}
    print(shares)
    assert all(shares[k] >= 0.9 if secret else shares[k] <= 0.1 for k, secret, _ in rows), shares


def test_features_against_plain_python(spark):
    parts = ["nat", "ion", "the", "ser"]
    found = sf.candidates(spark.createDataFrame([(1, f'x = "{h(3)}" the-nation/of.observers 12345678901234 AKIA{"Q" * 16} a')], "doc_id long, text string"), path=None)
    rows = sf.described(found, parts).collect()
    assert len(rows) == 4
    for r in rows:
        t, n = r.token, len(r.token)
        kinds = lambda c: "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "."
        assert r.digits == sum(c.isdigit() for c in t) / n and r.capitals == sum(c.isupper() for c in t) / n and r.distinct == len(set(t)) / n
        assert r.coverage == sum(t[i : i + 3].lower() in parts for i in range(n - 2)) / (n - 2)
        changes = sum(kinds(a) != "." and kinds(a) != kinds(b) for a, b in zip(t, t[1:])) + (kinds(t[-1]) != ".")
        assert r.transitions == changes / n and r.length == min(n, 200) and r.hex == float(t == h(3) or t.isdigit())


def test_sample_has_distinct_findings_and_all_made_ones(spark, monkeypatch):
    made = sf.made_findings(spark)
    kinds = made.where("label = 1").limit(12)
    copies = kinds.crossJoin(spark.range(300)).drop("id")
    seen = []
    keep = sf.materialise
    monkeypatch.setattr(sf, "materialise", lambda df, name: seen.append(keep(df, name)) or seen[-1])
    sf.train(copies.unionByName(kinds.withColumn("label", sf.F.lit(0))), ["nat"], made=made, per_class=10)
    rows = [r.asDict() for r in seen[0].collect()]
    assert len(rows) <= 20 + 800 and sum(r["label"] == 0 for r in rows) >= 200
    drawn = [r for r in rows if r["weight"] == sf.MOST_WEIGHT]
    distinct = sf.described(kinds, ["nat"]).select(*sf.FEATURES).distinct().count()
    assert len(drawn) == min(10, distinct) == len({tuple(r[f] for f in sf.FEATURES) for r in drawn})
