"""Export archives as cells and profiles; dates of every family; record texts against a plain walk over their lines."""

import random
import re

from pyspark.sql import functions as F

from tracewell.functions import dates
from tracewell.sources import exports, resumes

ARCHIVE = {
    "Profile.csv": 'First Name,Last Name,Headline,Geo Location,Websites\nAda,Lovelace,Backend engineer,"Brooklyn, New York","PERSONAL:(https://example.com),OTHER:(https://b.example/x)"\nSecond,Row,,,\n',
    "Email Addresses.csv": "Email Address,Confirmed,Primary\nold@example.com,Yes,No\nada@example.com,Yes,Yes\n",
    "PhoneNumbers.csv": "Extension,Number,Type\n,(555) 010-1990,MOBILE\n",
    "Positions.csv": 'Notes:\n"When exported, this file contains your positions."\nCompany Name,Title,Description,Location,Started On,Finished On\n'
    'Northwind Analytics,Backend Engineer Intern,"• Rewrote the ""nightly"" job.\nAdded contract tests.","New York, NY",Jun 2025,Aug 2025\nHunter College IT,Student Technician,,"New York, NY",Sep 2024,\n,,,,,\n,Freelancer\nHunter College IT,Student Technician\n',
    "Education.csv": 'School Name,Start Date,End Date,Notes,Degree Name\n"Hunter College, CUNY",2023,2027,,B.A. Computer Science\n,2020,,,None\n',
    "Skills.csv": "Name\nPython\n\nPostgreSQL\n",
    "Projects.csv": "Name,Description,Url,Start Date\ntidepool,Offline tide tables.,https://github.com/example/tidepool,Jan 2025\n",
    "Certifications.csv": "Name,Url,Authority,Started On,Finished On,License Number\nAWS Certified Cloud Practitioner,,Amazon Web Services,03/2025,,\n",
    "Other.csv": "Name\nnothing\n",
    "Empty.csv": "",
}


def put(folder, files):
    folder.mkdir()
    for name, text in files.items():
        (folder / name).write_bytes(text.encode("utf-8-sig"))


def test_profiles_of_archives(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    put(root / "a", ARCHIVE)
    put(root / "b", {"emails.csv": "Email\nfirst@example.com\nlast@example.com\n", "positions.csv": "Company,Position,Start Date\nAcme,,2019-5-01\n"})
    p = exports.profiles(exports.export_cells(spark, str(root)))
    basics = {r.archive.rsplit("/", 1)[-1]: r for r in p.basics.collect()}
    a = basics["a"]
    assert (a.name, a.headline, a.location, a.email, a.phone) == ("Ada Lovelace", "Backend engineer", "Brooklyn, New York", "ada@example.com", "(555) 010-1990")
    assert a.links == ["https://example.com", "https://b.example/x"]
    assert (basics["b"].name, basics["b"].email, basics["b"].links) == ("TODO your name", "first@example.com", [])

    entries = {(r.archive.rsplit("/", 1)[-1], r.entry_id): r for r in p.entries.collect()}
    one = entries["a", "exp-northwind-analytics-backend-engineer"]
    assert (one.section, one.name, one.title, one.location, one.start, one.end) == ("experience", "Northwind Analytics", "Backend Engineer Intern", "New York, NY", "2025-06", "2025-08")
    assert entries["a", "exp-hunter-college-it-student-technician"].end == "" and ("a", "exp-hunter-college-it-student-technician-2") in entries
    assert entries["a", "exp-freelancer"].name == "TODO company" and entries["b", "exp-acme"].title == "TODO title" and entries["b", "exp-acme"].start == "2019-05"
    school = entries["a", "edu-hunter-college-cuny"]
    assert (school.title, school.start, school.end) == ("B.A. Computer Science", "2023", "2027")
    assert entries["a", "proj-tidepool"].url == "https://github.com/example/tidepool" and entries["a", "proj-tidepool"].start == "2025-01"
    assert (entries["a", "cert-aws-certified-cloud"].title, entries["a", "cert-aws-certified-cloud"].start) == ("Amazon Web Services", "2025-03")
    assert len(entries) == 8

    lines = [(r.highlight_id, r.text) for r in p.highlights.orderBy("archive", "entry_id", "n").collect()]
    assert lines == [("exp-northwind-analytics-backend-engineer.h1", 'Rewrote the "nightly" job.'), ("exp-northwind-analytics-backend-engineer.h2", "Added contract tests."), ("proj-tidepool.h1", "Offline tide tables.")]
    assert [(r.n, r.skill) for r in p.skills.orderBy("n").collect()] == [(1, "Python"), (2, "PostgreSQL")]


def test_five_hundred_columns_and_cells_over_many_lines(spark, tmp_path):
    put(tmp_path / "a", {"wide.csv": ",".join(f"c{'x' * k}" for k in range(500)) + "\n" + ",".join(f'"v{k}\nmore, ""{k}"""' for k in range(500)) + "\nshort\n"})
    got = {(r.row, r.pos): r.value for r in exports.export_cells(spark, str(tmp_path)).collect()}
    assert len(got) == 1000 and got[1, 499] == 'v499\nmore, "499"' and got[2, 0] == "short" and got[2, 1] == ""


def test_bad_bytes_and_no_files(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"Name\ncaf\xe9\n")
    assert [r.value for r in exports.export_cells(spark, str(tmp_path)).collect()] == ["caf�"]
    (tmp_path / "none").mkdir()
    p = exports.profiles(exports.export_cells(spark, str(tmp_path / "none")))
    assert [df.count() for df in p] == [0, 0, 0, 0]


def test_dates_of_each_family(spark):
    record = {"Jun 2025": "2025-06", " June 2025 ": "2025-06", "Sept 2019": "2019-09", "Foo 2019": "2019", "06/2025": "2025-06", "6-2025": "2025-06", "2025-6-01": "2025-06", "2025-6": "2025-06", "2025": "2025", "": "", None: "", "Summer of 69": "Summer of 69", "13/2020": "2020-13"}
    families = {"Jun 2025": "month_name", "Foo 2019": "month_name", "6-2025": "month_number", "2025-6-01": "iso", "2025": "year", None: "empty", "Summer of 69": "as_written"}
    got = {r.t: r for r in spark.createDataFrame([(t,) for t in record], "t string").select("t", dates.record_date("t").alias("d")).collect()}
    assert {t: r.d.value for t, r in got.items()} == record and all(got[t].d.family == f for t, f in families.items())
    posts = {"Tue, 3 Jun 2024 10:00:00 GMT": ("2024-06-03", "mail"), "2024-06-03T10:00Z": ("2024-06-03", "iso"), "on 12 December 2020": ("2020-12-12", "mail"), "3 Foo 2024, noon": ("3 Foo 2024", "as_written"), "": ("", "empty"), None: ("", "empty"), "June 3rd, 2024": ("June 3rd, ", "as_written")}
    got = {r.t: tuple(r.d) for r in spark.createDataFrame([(t,) for t in posts], "t string").select("t", dates.post_date("t").alias("d")).collect()}
    assert got == posts
    ends = {"Present": ("", "current"), "now": ("", "current"), "Currently": ("", "current"), "May 2020": ("2020-05", "month_name"), None: ("", "empty")}
    got = {r.t: tuple(r.d) for r in spark.createDataFrame([(t,) for t in ends], "t string").select("t", dates.end_date("t").alias("d")).collect()}
    assert got == ends
    spark.conf.set("spark.sql.ansi.enabled", "true")
    assert spark.range(1).select(dates.record_date(F.lit("99/9999"))["value"].alias("v")).first().v == "9999-99"


RANGE = re.compile(resumes.DATES.removeprefix("(?i)"), re.I)
GLYPH = re.compile(resumes.BULLET)


def walked(lines):
    """(section, header, bullets, start, end) of each block, line after line."""
    out, section, block = [], None, None
    for line in lines:
        key = re.sub("[^a-z]", "", line.lower())
        heading = next((s for s, names in resumes.HEADINGS.items() if key in names and len(line) <= resumes.LONGEST_HEADING), None)
        if heading:
            section, block = heading, None
            continue
        if section is None:
            continue
        found, long = RANGE.search(line), len(line) >= resumes.LONG_LINE
        kind = "header"
        if GLYPH.match(line):
            kind = "bullet"
        elif not (found and (not long or found.end() >= len(line) - 2)):
            if long and block and (block[1] or block[2]):
                kind = "bullet"
            elif block and block[2] and (line[:1].islower() or line[:1].isdigit()):
                kind = "more"
        orphan = found and block and not block[3] and not RANGE.sub("", line).strip(" |,-–—")
        if block is None or (kind == "header" and block[2] and not orphan):
            block = [section, [], [], "", ""]
            out.append(block)
        if kind == "bullet":
            block[2].append(GLYPH.sub("", line).strip())
        elif kind == "more":
            block[2][-1] += " " + line
        else:
            if found and not block[3]:
                block[3], block[4] = found.group(1), found.group(2)
                line = RANGE.sub("", line).strip(" |,-–—")
            if line:
                block[1].append(line)
    return [tuple(map(lambda x: tuple(x) if isinstance(x, list) else x, b)) for b in out]


LINES = ["Experience", "Work Experience", "Employment", "Education", "Acme Corp", "Jan 2020 – Feb 2021", "2019 - Present", "• another thing", "- short", "3 things", "and went on", "Beta, NY | May 2018 - Jun 2019", "Engineer", "A" + " long line of words" * 4, "grew revenue between 2023 – 2024 by a lot of hard work and some luck", "Skills", "Projects", "B" + " long" * 12 + " 2020 – 2021"]


def test_blocks_are_a_walk_over_lines(spark):
    rng = random.Random(12)
    texts = [[rng.choice(LINES) for _ in range(rng.randint(0, 16))] for _ in range(600)]
    texts += [["Experience", "Jan 2020 – Feb 2021", "2019 - Present", "• another", "Jan 2020 – Feb 2021", "3 things", "Jan 2020 – Feb 2021"], ["Experience", "Jan 2020 – Feb 2021", "• another", "2019 - Present", "Jan 2020 – Feb 2021"], ["Work Experience", "Employment", "Acme"]]
    docs = spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate(texts)] + [(9999, None)], "doc_id long, text string")
    got = {}
    for r in resumes.resume_blocks(resumes.clean_lines(docs)).orderBy("doc_id", "block", "role", "n").collect():
        b = got.setdefault(r.doc_id, {}).setdefault(r.block, [r.section, [], [], r.start, r.end])
        b[1 if r.role == "header" else 2].append(r.text)
    for k, t in enumerate(texts):
        want = [b for b in walked(t) if b[1] or b[2]]  # a block of dates alone has no line to show
        assert [tuple(tuple(x) if isinstance(x, list) else x for x in b) for _, b in sorted(got.get(k, {}).items())] == want, t
