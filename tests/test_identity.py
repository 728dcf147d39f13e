"""Matching of rows against a plain turn-by-turn model of its rules."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from tidewell.operators import identity, rows as row_ops

ROW = "source_id string, source_pos int, ord long, row_id string, fields map<string,string>, reject string"
BY_NAME = ["crm"]


def company(email):
    host = email.partition("@")[2]
    return "" if not host or host == "gmail.com" else host


class Book:
    """The rules, one row after another over dictionaries."""

    def __init__(self):
        self.email, self.url, self.has, self.group, self.fields, self.made = {}, {}, {}, {}, {}, {}

    def apply(self, table):
        groups = {}
        for r in sorted(table, key=lambda r: (r[1], r[2])):
            groups.setdefault((r[0], r[3]), []).append(r)
        out = []
        for (source, row_id), members in groups.items():
            for _, _, place, _, f, reject in members:
                email, url = f.get("email", ""), f.get("linkedin_url", "")
                if reject or not (email or url or source in BY_NAME):
                    continue
                lead = self.find(source, row_id, email, url, f)
                out.append((source, row_id, place, lead, self.write(lead, email, url, f)))
                self.group[(source, row_id)] = lead
        return out

    def find(self, source, row_id, email, url, f):
        if (source, row_id) in self.group:
            return self.group[(source, row_id)]
        found = self.email.get(email) if email else self.url.get(url) if url else None
        key = (f.get("company.domain", ""), " ".join(f.get("full_name", "").lower().split()))
        if found is None and not email and source in BY_NAME and all(key):
            alike = [x for x, v in self.fields.items() if (v.get("company.domain"), " ".join(v.get("full_name", "").lower().split())) == key]
            found = alike[0] if len(alike) == 1 else None
        return found or f"{source}|{row_id}"

    def write(self, lead, email, url, f):
        mine = self.fields.setdefault(lead, {})
        odd = False
        if email:
            odd |= self.email.setdefault(email, lead) != lead
        if url:
            if url not in self.url and lead not in self.has:
                self.url[url] = lead
                self.has[lead] = url
            odd |= self.url.get(url) != lead
        domain = f.get("company.domain", "") or company(email)
        for k, v in (("company.domain", domain), ("full_name", f.get("full_name", ""))):
            if v:
                mine.setdefault(k, v)
        return odd


def make(seed, n=120, keys=14):
    r = random.Random(seed)
    out = []
    for k in range(n):
        source, pos = r.choice([("web", 0), ("crm", 1), ("receiver", 2)])
        f = {}
        if r.random() < 0.5:
            f["email"] = f"p{r.randrange(keys)}@{r.choice(['a.example', 'b.example', 'gmail.com'])}"
        if r.random() < 0.5:
            f["linkedin_url"] = f"linkedin.com/in/u{r.randrange(keys)}"
        if r.random() < 0.4:
            f["company.domain"] = r.choice(["a.example", "b.example"])
        if r.random() < 0.4:
            f["full_name"] = f"Name  {r.randrange(4)}"
        name = " ".join(f.get("full_name", "").lower().split())
        row_id = f"c{r.randrange(keys)}" if source == "receiver" else f.get("email") or f.get("linkedin_url") or (f"{f.get('company.domain')}|{name}" if f.get("company.domain") and name else f"row:{k}")
        reject = "no key" if not f.get("email") and not f.get("linkedin_url") and not (f.get("company.domain") and name) else None
        out.append((source, pos, k, row_id, f, reject))
    return out


def empty(spark):
    return spark.createDataFrame([], "key string, kind string, lead_id string, source_id string"), spark.createDataFrame([], "source_id string, row_id string, lead_id string")


def as_table(matched):
    return sorted((r["source_id"], r["row_id"], r["ord"], r["lead_key"], r["key_conflict"]) for r in matched.collect())


@pytest.mark.parametrize("seed", range(2))
def test_equals_turn_by_turn(spark, seed):
    table = make(seed)
    got = identity.match_rows(spark.createDataFrame(table, ROW).repartition(3), *empty(spark), run_ms=1, by_name_sources=BY_NAME)
    assert as_table(got) == sorted(Book().apply(table))


def test_stored_leads_and_earlier_rows(spark):
    book, table, later = Book(), make(11, 80), [(s, p, o + 1_000, *rest) for s, p, o, *rest in make(12, 80)]
    book.apply(table)
    known = [(k, "email", v, "web") for k, v in book.email.items()] + [(k, "linkedin", v, "web") for k, v in book.url.items()]
    fields = [(lead, k, v, "web") for lead, f in book.fields.items() for k, v in f.items()] + [(lead, "linkedin_url", u, "web") for lead, u in book.has.items()]
    got = identity.match_rows(
        spark.createDataFrame(later, ROW),
        spark.createDataFrame(known, "key string, kind string, lead_id string, source_id string"),
        spark.createDataFrame([(*k, v) for k, v in book.group.items()], "source_id string, row_id string, lead_id string"),
        run_ms=1,
        by_name_sources=BY_NAME,
        known_fields=spark.createDataFrame(fields, "lead_id string, field string, value string, source_id string"),
    )
    assert as_table(got) == sorted(book.apply(later))


def test_merged_leads_are_followed(spark):
    rows = spark.createDataFrame([("web", 0, 1, "a@x.example", {"email": "a@x.example"}, None)], ROW)
    known = spark.createDataFrame([("a@x.example", "email", "old", "web")], "key string, kind string, lead_id string, source_id string")
    live = spark.createDataFrame([("old", "new"), ("new", "new")], "lead_id string, live_id string")
    assert identity.match_rows(rows, known, empty(spark)[1], 1, live=live).first()["lead_id"] == "new"


def test_rows_without_a_key_are_refused(spark):
    table = [("web", 0, 1, "x|n", {"company.domain": "x.example", "full_name": "N"}, None), ("crm", 1, 2, "x|n", {"company.domain": "x.example", "full_name": "N"}, None)]
    df = spark.createDataFrame(table, ROW)
    assert [(r["source_id"]) for r in identity.match_rows(df, *empty(spark), 1, BY_NAME).collect()] == ["crm"]
    assert {r["source_id"]: r["reject"] is None for r in identity.refusals(df, BY_NAME).collect()} == {"web": False, "crm": True}
    assert identity.match_rows(df, *empty(spark), 1).count() == 0


def test_ids_are_version_7_and_replay(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    ids = [uuid.UUID(r[0]) for r in keys.select(identity.lead_id_for(1_706_659_200_000, F.col("k"))).collect()]
    assert all(i.version == 7 and i.variant == uuid.RFC_4122 and i.int >> 80 == 1_706_659_200_000 for i in ids) and ids[0] != ids[1]
    assert ids[0] == uuid.UUID(keys.select(identity.lead_id_for(1_706_659_200_000, F.col("k"))).first()[0])


def test_fields_of_leads(spark):
    table = [
        ("web", 0, 1, "a@x.example", {"email": "a@x.example", "title": "CEO", "linkedin_url": "linkedin.com/in/a"}, None),
        ("web", 0, 2, "a@x.example", {"email": "a@x.example", "title": "CTO", "company.domain": "y.example", "linkedin_url": "linkedin.com/in/b"}, None),
        ("receiver", 2, 3, "c1", {"email": "r1@gmail.com"}, None),
        ("receiver", 2, 4, "c1", {"email": "r2@gmail.com", "company.domain": "z.example"}, None),
        ("receiver", 2, 5, "c2", {"email": "s1@gmail.com"}, None),
        ("web", 3, 6, "s1@gmail.com", {"email": "s1@gmail.com"}, None),
        ("receiver", 4, 7, "c2", {"email": "s2@gmail.com"}, None),
    ]
    df = spark.createDataFrame(table, ROW)
    m = identity.match_rows(df, *empty(spark), 1).cache()
    key = {r["lead_id"]: r["lead_key"] for r in m.collect()}
    got = {(key[r["lead_id"]], r["field"]): (r["value"], r["derived"]) for r in identity.lead_fields(df, m).collect()}
    assert got == {
        ("web|a@x.example", "email"): ("a@x.example", False),
        ("web|a@x.example", "title"): ("CEO", False),
        ("web|a@x.example", "linkedin_url"): ("linkedin.com/in/a", False),
        ("web|a@x.example", "company.domain"): ("x.example", True),
        ("receiver|c1", "email"): ("r2@gmail.com", False),
        ("receiver|c1", "company.domain"): ("z.example", False),
        ("receiver|c2", "email"): ("s1@gmail.com", False),
    }


def test_no_rows(spark):
    assert identity.match_rows(spark.createDataFrame([], ROW), *empty(spark), 1, BY_NAME).count() == 0


def test_header_rows_to_leads(spark):
    cells = [("web", 0, k, {"E-mail Address": f" P{k % 3}@X.example ", "Segment": s}) for k, s in enumerate(["a", "", "b", "c"])]
    raw = spark.createDataFrame(cells, "source_id string, source_pos int, ord long, cols map<string,string>")
    m = identity.match_rows(row_ops.normalize(raw, ["E-mail Address", "Segment"]), *empty(spark), 1)
    assert sorted((r["ord"], r["lead_key"]) for r in m.collect()) == [(k, f"web|p{k % 3}@x.example") for k in range(4)]


def by_names(seed, n):
    """Many rows of few names and companies, most of them without a key; two thirds of all have one name at one company."""
    r, rows = random.Random(seed), []
    for k in range(n):
        hot = r.random() < 0.66
        name, company_ = ("Ada  Lee", "x.example") if hot else (r.choice(["Bo", "Cy", "ada lee", ""]), r.choice(["x.example", "y.example", ""]))
        f = {"full_name": name, "company.domain": company_}
        if r.random() < 0.15:
            f["email"] = f"p{r.randrange(40)}@{r.choice(['x', 'y'])}.example"
        if r.random() < 0.06 and not hot:
            f["linkedin_url"] = f"linkedin.com/in/{r.randrange(5)}"
        f = {k_: v for k_, v in f.items() if v}
        source = r.choice(["crm", "crm", "crm", "web"])
        rows.append((source, 0 if source == "crm" else 1, k, f"id{r.randrange(n)}", f, None))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_names_equal_turn_by_turn(spark, seed):
    table = by_names(seed, 120)
    got = identity.match_rows(spark.createDataFrame(table, ROW).repartition(3), *empty(spark), run_ms=1, by_name_sources=BY_NAME)
    assert as_table(got) == sorted(Book().apply(table))


def test_a_hot_name_needs_no_turns(spark, monkeypatch):
    """Rows of one name and company, a few leads that bring it with an email: none goes to the turn-by-turn task."""

    def turns(events):
        raise AssertionError("a name without URLs was settled in turn")

    monkeypatch.setattr(identity, "_take_turns", turns)
    people = {"full_name": "Ada Lee", "company.domain": "x.example"}
    table = [("crm", 0, k, f"id{k}", dict(people), None) for k in range(600)]
    for k in (0, 200, 400):  # once first to go by the name, then a second lead that does
        table[k] = ("crm", 0, k, f"id{k}", people | {"email": f"p{k}@x.example"}, None)
    got = identity.match_rows(spark.createDataFrame(table, ROW).repartition(4), *empty(spark), run_ms=1, by_name_sources=BY_NAME)
    want = sorted(Book().apply(table))
    assert as_table(got) == want
    assert sum(w[3] == "crm|id0" for w in want) == 200


def test_profile_urls_are_parted_once_and_blank_ones_not_at_all(spark):
    from tidewell.functions import text as tx

    odd = [None, "", "  ", "https://www.linkedin.com/in/Ada/?x=1", "//linkedin.com/in/bo", "linkedin.com:443/pub/a/b/c/d/e", "u@linkedin.com/in/%41+b", "linkedin.com/in/%zz", "linkedin.com/in/..", "linkedin.com/in", "evil.com/linkedin.com/in/x", "http://", "x.linkedin.com//in//q#f"]
    want = [*[""] * 3, "linkedin.com/in/ada", "linkedin.com/in/bo", "linkedin.com/pub/a/b/c/d", "linkedin.com/in/a+b", "", "", "", "", "", "linkedin.com/in/q"]
    df = spark.createDataFrame(list(enumerate(odd)), "k int, u string")
    out = df.select("k", tx.canonical_linkedin(F.col("u"), False).alias("a"), tx.canonical_linkedin(F.col("u")).alias("b"))
    assert [(r["a"], r["b"]) for r in out.orderBy("k").collect()] == [(w, w) for w in want]
    plan = df.select(tx.canonical_linkedin(F.col("u"), False).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 2 and plan.count("try_url_decode") + plan.count("tryDecode") <= 2


def test_lead_fields_joins_the_rows_once(spark, monkeypatch):
    from tidewell import queries

    wrote = []
    monkeypatch.setattr(identity, "materialize", lambda df, tag, f=identity.materialize: (wrote.append(tag), f(df, tag))[1])
    out = queries.lead_fields(spark, "/root/testdata/sf0.001")
    assert wrote[-1] == "matched-fields"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan and "o_orderkey" not in plan  # the tables were read, normalized and matched before
