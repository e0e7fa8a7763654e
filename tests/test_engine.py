"""Extraction, pairs, stores, reports, sources, plans and the command line."""

import base64
import email.message
import io
import json
import urllib.error

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmatch import cli, display, queries
from quillmatch import settings as config
from quillmatch.operators import c_source, compare, extract, html_tree, pairs, python_source, report
from quillmatch.plans import check, html
from quillmatch.sources import files, github, links, store

THIRD = (
    "import os\n\n\ndef join_path(path):\n    cwd = os.getcwd()\n\n    return os.path.join(cwd, path)\n\n\n"
    "def example(new_path, is_exist):\n    if is_exist:\n        new_path = join_path(new_path)\n\n    return new_path\n"
)


def test_python_features():
    f = python_source.extract(queries.CONSTANTS)
    assert (f["count_of_nodes"], f["count_unodes"]) == (42, 15)
    assert f["operators"] == {"AugAssign": 2, "Add": 2, "AnnAssign": 1, "Assign": 1}
    assert f["keywords"] == {"FunctionDef": 1, "Return": 1, "If": 1} and f["literals"] == {"Constant": 6}
    assert f["head_nodes"] == ["INT_CONST[1]", "INT_CONST[2]", "FLOAT_CONST[3]", "my_func[6]", "If[12]"]
    assert f["sha256"] == "cc112603b970b41f72e0488dcc6f9e26889a9298c752e61a25d3e10caf512e43"
    assert len(f["tokens"]) == len(f["tokens_pos"])
    assert python_source.extract("def f(:") is None and python_source.decode(b"") is None and python_source.decode(b"\xff") is None
    assert python_source.extract("not x")["tokens_pos"][0] == (1, 0)


def test_c_lexer():
    code = '#include <x>\n// a + b\nlong gcd(long a, long b) { if (b == 0L) { return a; } return gcd(b, a % b); } /* "q" */\nchar *s = "a+b";\n'
    kinds = c_source.lex(code)
    assert ("literal", '"a+b"') in kinds and ("literal", "0L") in kinds and not any("include" in s for _, s in kinds)
    f = c_source.extract(code)
    if not c_source.has_clang():
        assert f["operators"] == {"==": 1, "%": 1, "*": 1, "=": 1}
        assert f["keywords"] == {"long": 3, "if": 1, "return": 2, "char": 1}
        assert f["head_nodes"][0] == "gcd"


def _kinds(code):
    f = c_source.extract(code)
    return [f["from_num"][u].split(".")[1] for _, u in f["structure"]]


# Numbers of the cursor kinds and hash of two known functions.
C_TOKENS = [
    [8, 10, 10, 202, 205, 114, 100, 101, 106, 214, 100, 101, 214, 103, 100, 101, 100, 101, 114, 100, 101, 100, 101],
    [8, 10, 10, 202, 205, 114, 100, 101, 106, 202, 214, 100, 100, 101, 214, 103, 100, 101, 100, 101, 114, 100, 101, 100, 101],
]
C_SHA256 = "e60cabdc857dad1c75022143429806e146ad5fe299528fc47426a2f0c5c2f9a7"


@pytest.mark.skipif(c_source.has_clang(), reason="the parser stands in for the bindings")
def test_c_goldens():
    first, second = (c_source.extract(code) for code in (queries.C_FIRST, queries.C_SECOND))
    assert [first["tokens"], second["tokens"]] == C_TOKENS
    assert (first["count_of_nodes"], second["count_of_nodes"]) == (23, 25) and first["count_unodes"] == second["count_unodes"] == 10
    assert first["head_nodes"] == second["head_nodes"] == ["gcd"] and second["sha256"] == C_SHA256
    assert second["operators"] == {"==": 1, "%": 1} and second["literals"] == {"0L": 1}
    assert second["keywords"] == {"int": 1, "if": 1, "return": 2, "long": 2}


@pytest.mark.skipif(c_source.has_clang(), reason="the parser stands in for the bindings")
@pytest.mark.parametrize(
    "code, kinds",
    [
        ("int n;", "VAR_DECL KEYWORD IDENTIFIER"),
        ("#define N 3\nint a[N];", "MACRO_DEFINITION IDENTIFIER LITERAL VAR_DECL INTEGER_LITERAL"),
        ("using namespace std; namespace n { int hidden; } double d = 1;", "VAR_DECL UNEXPOSED_EXPR INTEGER_LITERAL"),
        ("#if 0\nint gone = 1;\n#else\nint n = 2;\n#endif\n", "VAR_DECL INTEGER_LITERAL"),
        ("struct P { int x; P(int a) : x(a) {} }; P::~P() {}", "STRUCT_DECL FIELD_DECL CONSTRUCTOR PARM_DECL MEMBER_REF UNEXPOSED_EXPR DECL_REF_EXPR COMPOUND_STMT DESTRUCTOR TYPE_REF COMPOUND_STMT"),
        ("struct P { int x; }; void f() { P *p = new P(); delete p; }", "STRUCT_DECL FIELD_DECL FUNCTION_DECL COMPOUND_STMT DECL_STMT VAR_DECL TYPE_REF CXX_NEW_EXPR TYPE_REF CALL_EXPR CXX_DELETE_EXPR UNEXPOSED_EXPR DECL_REF_EXPR"),
        ("template <class T> T top(T a) { return a; }", "FUNCTION_TEMPLATE TEMPLATE_TYPE_PARAMETER TYPE_REF PARM_DECL TYPE_REF COMPOUND_STMT RETURN_STMT DECL_REF_EXPR"),
        ("void f(int *p) { for (int i = 0; i < 3; ++i) p[i] += 1; }", "FUNCTION_DECL PARM_DECL COMPOUND_STMT FOR_STMT DECL_STMT VAR_DECL INTEGER_LITERAL BINARY_OPERATOR UNEXPOSED_EXPR DECL_REF_EXPR INTEGER_LITERAL UNARY_OPERATOR DECL_REF_EXPR COMPOUND_ASSIGNMENT_OPERATOR ARRAY_SUBSCRIPT_EXPR UNEXPOSED_EXPR DECL_REF_EXPR UNEXPOSED_EXPR DECL_REF_EXPR INTEGER_LITERAL"),
        ("void f() { std::vector<std::vector<int>> v; while (true) { break; } }", "FUNCTION_DECL COMPOUND_STMT DECL_STMT VAR_DECL NAMESPACE_REF TEMPLATE_REF NAMESPACE_REF TEMPLATE_REF CALL_EXPR WHILE_STMT CXX_BOOL_LITERAL_EXPR COMPOUND_STMT BREAK_STMT"),
    ],
)
def test_c_trees(code, kinds):
    assert _kinds(code) == kinds.split()


@given(st.lists(st.sampled_from("int x ( ) { } [ ] ; , < > >> * & = == if else for while return struct class P : :: 1 'c' \"s\" new template using case #define operator ~ -> . ? \n".split(" ")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_c_parser_takes_anything(parts):
    f = c_source.extract(" ".join(parts))
    assert f["count_of_nodes"] == len(f["structure"]) and all(d >= 1 for d, _ in f["structure"])


def test_c_sources_too_deep():
    assert c_source.extract("int n = " + "(" * 20_000 + "1" + ")" * 20_000 + ";")["count_of_nodes"]
    assert c_source.extract("int f() " + "{" * 20_000 + "}" * 20_000)["count_of_nodes"]


def test_html_tree():
    f = html_tree.extract("<html><body><p>a<br>b</p><p>c</body></html>")
    assert [d for d, _ in f["structure"]] == [1, 2, 3, 4, 3]


def test_compare_goldens(spark):
    r = check.compare_works(spark, queries.FIRST, queries.SECOND).first()
    assert [round(x, 3) for x in r["fast"]] == [0.737, 0.667, 1.0, 0.75, 0.774]
    assert r["structure"]["similarity"] == pytest.approx(0.823, abs=1e-3)
    assert r["structure"]["compliance_matrix"] == [[[19, 24], [7, 21]], [[5, 27], [8, 9]]]
    assert check.compare_works(spark, queries.FIRST, THIRD, threshold=60).count() == 0
    r = check.compare_works(spark, queries.FIRST, THIRD).first()
    assert [round(x, 3) for x in r["fast"]] == [0.24, 0.0, 0.6, 0.0, 0.218]
    r = check.compare_works(spark, queries.FIRST, queries.SECOND, weights=(0.5, 0.6, 0.7, 0.8)).first()
    assert round(r["fast"]["weighted_average"], 3) == 0.796


def test_candidates_lose_nothing(spark):
    rows = [(f"w{i}", "c" + str(i % 3), [(i // 3 + k) % 7 for k in range(4 + i % 5)]) for i in range(30)]
    f = spark.createDataFrame(rows, "filepath string, collection_id string, tokens array<int>")
    f = f.withColumns({c: F.create_map().cast("map<string,int>") for c in ("operators", "keywords", "literals")})
    for mode in ("many_to_many", "one_to_one"):
        every = pairs.all_pairs(f, mode).select(F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second"))
        sides = compare.fast_compare(compare.with_sides(every, f, ("tokens", "operators", "keywords", "literals")))
        expected = {tuple(r) for r in sides.where(compare.passes(65, F.col("fast.weighted_average"))).select("first", "second").collect()}
        got = {tuple(r) for r in pairs.candidates(f, 65, 3, mode).collect()}
        assert expected and expected <= got
    assert [pairs.iterations(n, m) for n, m in ((10, "many_to_many"), (3, "one_to_one"), (1, "one_to_one"))] == [45, 3, 0]
    with pytest.raises(ValueError):
        pairs.iterations(3, "bad")


@pytest.fixture
def works(tmp_path):
    folder = tmp_path / "works"
    (folder / "sub").mkdir(parents=True)
    (folder / "one.py").write_text(queries.FIRST)
    (folder / "sub" / "two.py").write_text(queries.SECOND)
    (folder / "three.py").write_text(THIRD)
    (folder / "empty.py").write_text("")
    (folder / "broken.py").write_text("def f(:")
    (folder / "note.txt").write_text("x")
    return folder


def test_check_stores_and_reports(spark, works, tmp_path):
    f, r = store.feature_store(spark, str(tmp_path / "features")), store.result_store(spark, str(tmp_path / "results"))
    report_path = str(tmp_path / "report.csv")
    comparator = check.WorksComparator(spark, "py", features=f, results=r, csv_report=report_path)
    done = comparator.check(directories=[str(works)])
    assert done.exit_code == 200 and done.found.count() == 1
    assert f.read().count() == 3 and r.read().count() == 1
    again = comparator.check(directories=[str(works)])
    assert again.found.count() == 0 and again.cached.count() == 1 and again.exit_code == 200
    assert again.shown(2) is None and again.shown(1).count() == 0 and again.shown(0).count() == 1
    a, b = r.read().first(), store.read_csv(spark, report_path).first()
    assert a["fast"] == b["fast"] and a["structure"] == b["structure"] and a["first_heads"] == b["first_heads"]
    for kind in ("general", "sources"):
        path = html.html_report_create(r.read(), str(tmp_path), kind, first_root=str(works / "one"), second_root=str(works / "sub"))
        assert "my_func[1]" in open(path).read()
    with pytest.raises(ValueError):
        report.under_roots(r.read(), "a", None)
    table = report.compliance_table(a)
    assert table.shape == (2, 2)
    r.clear()
    assert r.read().count() == 0


def test_same_heads(spark):
    info = check.compare_works(spark, queries.FIRST, queries.SECOND)
    rows = {(x["path"], x["head"], x["other_head"], x["percent"]) for x in report.same_heads(info).collect()}
    assert ("first", "If[7]", "my_func[1]", 18.52) in rows and ("second", "If[7]", "my_func[1]", 33.33) in rows


def test_scan(spark, works):
    found = {r["filepath"].rsplit("/", 1)[-1] for r in files.works_from_directory(spark, str(works), "py").collect()}
    assert found == {"one.py", "two.py", "three.py", "broken.py"}
    found = {r["filepath"].rsplit("/", 1)[-1] for r in files.works_from_directory(spark, str(works), "py", "sub").collect()}
    assert found == {"two.py"}
    assert files.works_from_files(spark, [str(works / "note.txt")], "py").count() == 1


class Canned:
    def __init__(self, replies):
        self.replies = replies

    def get(self, path, params=None):
        return self.replies[path]


def canned():
    commit = {"sha": "c1", "commit": {"author": {"date": "2022-12-29T10:10:41Z"}}}
    return Canned({
        "/users/o": {"type": "Organization"}, "/orgs/o/repos": [{"name": "a-repo", "html_url": "https://github.com/o/a-repo"}, {"name": "other", "html_url": "https://github.com/o/other"}],
        "/repos/o/a-repo": {"default_branch": "main"}, "/repos/o/a-repo/branches/main": {"commit": commit}, "/repos/o/a-repo/branches": [{"name": "main", "commit": {"sha": "c1"}}],
        "/repos/o/a-repo/git/trees/c1": {"tree": [{"path": "src", "type": "tree", "sha": "t1"}, {"path": "x.md", "type": "blob", "sha": "b0"}]},
        "/repos/o/a-repo/git/trees/t1": {"tree": [{"path": "u.py", "type": "blob", "sha": "b1"}]},
        "/repos/o/a-repo/commits": [commit], "/repos/o/a-repo/git/blobs/b1": {"content": base64.b64encode(queries.FIRST.encode()).decode()},
        "/repos/o/a-repo/contents/src": [{"path": "src/u.py", "name": "u.py", "type": "file", "sha": "b1"}],
        "/repos/o/a-repo/pulls": [{"number": 1, "commits_url": "cu", "head": {"label": "me:topic"}, "state": "open", "draft": False}], "cu": [{"sha": "p1"}],
        "/users/x": {"type": "bot"},
    })


def test_code_host(spark):
    host = github.Host(canned(), "py")
    assert [r.name for r in host.repositories("o", r"\ba")] == ["a-repo"]
    works = list(host.repository_files("https://github.com/o/a-repo"))
    assert [(w.link, w.commit.date) for w in works] == [("https://github.com/o/a-repo/blob/main/src/u.py", "2022-12-29T10:10:41Z")]
    assert [w.link for w in host.content_files("https://github.com/o/a-repo/tree/main/src")] == ["https://github.com/o/a-repo/tree/main/src/u.py"]
    assert [p.branch for p in host.pulls("o", "a-repo")] == ["topic"] and [b.name for b in host.branches("o", "a-repo")] == ["main"]
    with pytest.raises(SystemExit):
        list(host.repositories("x"))

    class Source(github.HostSource):
        client = canned()

        @classmethod
        def name(cls):
            return "canned_host"

    spark.dataSource.register(Source)
    rows = spark.read.format("canned_host").option("user", "o").option("repoRegexp", "^a").option("extension", "py").load()
    assert rows.count() == 1
    assert extract.features_from_works(rows, "py").first()["count_of_nodes"] > 0


def test_host_that_puts_off(monkeypatch):
    asked, slept = [], []

    def answer(code, **headers):
        message = email.message.Message()
        for k, v in headers.items():
            message[k.replace("_", "-")] = v
        return urllib.error.HTTPError("u", code, "no", message, io.BytesIO(b'{"message": "no"}'))

    def client_for(*replies):
        left = list(replies)

        def urlopen(request):
            asked.append(request)
            reply = left.pop(0)
            if isinstance(reply, Exception):
                raise reply
            out = io.BytesIO(json.dumps(reply).encode())
            out.headers = {}
            return out

        monkeypatch.setattr(github.urllib.request, "urlopen", urlopen)
        monkeypatch.setattr(github.time, "sleep", slept.append)
        return github.Client(waits=(1, 2))

    assert client_for(answer(503), answer(403, Retry_After="7"), {"a": 1}).get("x") == {"a": 1} and slept == [1, 7]
    slept.clear()
    reset = str(int(github.time.time()) + 30)
    assert client_for(answer(403, X_RateLimit_Remaining="0", X_RateLimit_Reset=reset), []).get("x") == [] and 25 < slept[0] < 35
    for replies, times in (([answer(404)], 1), ([answer(403)], 1), ([answer(403, Retry_After="99999")], 1), ([answer(502)] * 3, 3)):
        asked.clear()
        with pytest.raises(SystemExit):
            client_for(*replies).get("x")
        assert len(asked) == times


@pytest.mark.parametrize(("kind", "url"), [(links.HostUrl, "ftp://github.com/x"), (links.RepoUrl, "https://github.com/o"), (links.ContentUrl, "https://github.com/o/r"), (links.HostUrl, "https://example.com/a")])
def test_bad_links(kind, url):
    with pytest.raises(ValueError):
        kind(url)


def test_good_links():
    u = links.ContentUrl("https://github.com/o/r/blob/main/a/b.py")
    assert (u.owner, u.repo, u.branch, u.path) == ("o", "r", "main", "a/b.py")
    assert links.RepoUrl("https://github.com/o/r/").repo == "r"


@pytest.mark.parametrize("args", [
    ["check"], ["settings", "modify"], ["check", "-ext", "py", "-re", "x"], ["check", "-ext", "py", "-pe", "x"], ["settings", "modify", "-t", "49"],
    ["report", "create", "-p", "x", "-frp", "y"], ["check", "-ext", "py", "-d", "no-such-folder"], ["settings", "modify", "-md", "2"], ["settings", "modify", "-nl", "0"],
])
def test_bad_arguments(args):
    with pytest.raises(SystemExit):
        cli.parse(args)


def test_messages_in_russian(tmp_path, monkeypatch, capsys):
    path = tmp_path / "s.json"
    config.modify({"language": "ru"}, path)
    monkeypatch.setenv("QUILLMATCH_CONFIG", str(path))
    with pytest.raises(SystemExit):
        cli.parse(["settings", "modify"])
    assert "Нечего изменять" in capsys.readouterr().err
    config.modify({"language": "en"}, path)
    with pytest.raises(SystemExit):
        cli.parse(["settings", "modify"])
    assert "nothing to modify" in capsys.readouterr().err


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    assert config.read_settings(path)["threshold"] == 65
    config.modify({"threshold": 70, "reports": tmp_path}, path)
    assert config.read_settings(path)["threshold"] == 70 and json.loads(path.read_text())["max_depth"] == 999
    path.write_text("{")
    assert config.read_settings(path)["threshold"] == 65
    assert "mongo_pass" not in config.table({"mongo_pass": "x", "threshold": 1})


def test_progress():
    stage = lambda done, total: type("Stage", (), {"numCompletedTasks": done, "numTasks": total})
    p = display.Progress.of_stages([stage(1, 4), None, stage(2, 2)], began=100.0)
    assert (p.done, p.total, p.share) == (3, 6, 0.5) and p.seconds_left(110.0) == 10
    assert p.line(8, 110.0) == "50.0% of 6 tasks, 0:00:10 passed, about 0:00:10 left, 8 workers"
    assert "unknown" in display.Progress(0, 5, 100.0).line(1, 101.0) and display.Progress().share == 1.0
    assert display.styled("x", "red") == "\033[91mx\033[0m" and display.styled("x") == "x"
    assert display.highlight("a\nb", [(1, 0), (2, 0)], [1]).count("\033") == 3


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string")


def test_store_of_two_writers(spark, tmp_path):
    """Of two writers that begin from one version neither loses its rows."""
    schema = rows_of(spark, []).schema
    one, two = (store.Store(spark, str(tmp_path / "s"), schema, ["k"]) for _ in range(2))
    one.upsert(rows_of(spark, [(1, "a"), (2, "b")]))
    commit, raced = one._commit, []

    def late(version, folders):
        if not raced:
            raced.append(two.upsert(rows_of(spark, [(2, "c"), (3, "d")])))
        return commit(version, folders)

    one._commit = late
    one.upsert(rows_of(spark, [(1, "e"), (4, "f"), (4, "f")]))
    expected = [(1, "e"), (2, "c"), (3, "d"), (4, "f")]
    assert sorted(map(tuple, two.read().collect())) == expected
    raced.clear()
    one.merge()  # another upsert comes in between
    assert sorted(map(tuple, one.read().collect())) == expected
    with pytest.raises(Exception, match="."):
        one._fs.getFileStatus(one._Path(f"{one._root}/versions/v000000099"))
    one.clear()
    assert one.read().count() == 0


def test_store_keeps_what_frames_read(spark, tmp_path, monkeypatch):
    """A frame whose cached blocks are lost is read again after upserts and merges."""
    s = store.Store(spark, str(tmp_path / "s"), rows_of(spark, []).schema, ["k"])
    s.upsert(rows_of(spark, [(1, "a")]))
    held = s.read().persist()
    assert held.count() == 1
    monkeypatch.setattr(store, "MOST_FOLDERS", 2)
    for k in range(4):
        s.upsert(rows_of(spark, [(k, "b")]))
    held.unpersist(True)
    assert [tuple(r) for r in held.collect()] == [(1, "a")]
    assert sorted(map(tuple, s.read().collect())) == [(k, "b") for k in range(4)]
    s.vacuum(0)
    assert len(s._names("data")) <= 3 and s.read().count() == 4


def test_results_are_stored_batch_by_batch(spark, works, tmp_path, monkeypatch):
    """What was found before a run died is kept, and the next run takes up the rest."""
    r = store.result_store(spark, str(tmp_path / "r"))
    make = lambda **more: check.WorksComparator(spark, "py", threshold=None, results=r, flush_pairs=1, **more)
    upsert, n = r.upsert, []

    def dies(rows):
        if n:
            raise OSError("lost")
        n.append(rows.count())
        upsert(rows)

    monkeypatch.setattr(r, "upsert", dies)
    with pytest.raises(OSError):
        make().check(directories=[str(works)])
    assert r.read().count() == n[0] > 0
    monkeypatch.setattr(r, "upsert", upsert)
    done = make().check(directories=[str(works)])
    assert done.cached.count() == n[0] and r.read().count() == 3


def test_streaming(spark, works, tmp_path):
    from quillmatch.streaming import works as stream

    f, r = store.feature_store(spark, str(tmp_path / "f")), store.result_store(spark, str(tmp_path / "r"))
    q = stream.start(spark, str(works), "py", f, r, str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(120)
    assert f.read().count() == 3 and r.read().count() == 1


def test_registered_functions(spark):
    from quillmatch.functions.register import register

    register(spark)
    row = spark.sql("SELECT jaccard(array('a','b','c','d'), array('b','c','d','e'), 2) AS j, counter_metric(map('a', 1), map('a', 2)) AS m, lcs(array('a','b'), array('b')) AS l, pyround(2.675D) AS r").first()
    assert tuple(row) == (0.5, 0.5, 1, 2.67)


def test_pairwise_matrix(spark):
    f = spark.createDataFrame([("a", [1, 2, 3, 4]), ("b", [1, 2, 3, 4]), ("c", [9, 9, 9])], "filepath string, tokens array<int>").withColumn("collection_id", F.lit("x"))
    rows = {r["first"]: r for r in check.pairwise_matrix(f).collect()}
    assert rows["a"]["b"] == 1.0 and rows["a"]["c"] == 0.0


@pytest.mark.parametrize("kind", ["csv", "mongo"])
def test_command_line(spark, works, tmp_path, monkeypatch, capsys, kind):
    monkeypatch.setenv("QUILLMATCH_CONFIG", str(tmp_path / "settings.json"))
    reports = tmp_path / "reports"
    reports.mkdir()
    assert cli.main(["report", "create", "-p", str(tmp_path)]) == 1
    assert cli.main(["settings", "modify", "-r", str(reports), "-re", kind, "-t", "60", "-sp", "1"]) == 0
    assert cli.main(["settings", "show"]) == 0 and "60" in capsys.readouterr().out
    assert cli.main(["check", "-ext", "py", "-d", str(works)]) == 200
    assert "May be similar" in capsys.readouterr().out
    assert cli.main(["check", "-ext", "py", "-f", str(works / "three.py")]) == 0
    for report_type in ("general", "sources"):
        assert cli.main(["report", "create", "-p", str(tmp_path), "-t", report_type]) == 0
    assert (tmp_path / "report.html").exists() and (tmp_path / "sources.html").exists()


def test_overlaps_against_brute_force(spark):
    """Copies of one path, sizes that differ, grams that very many works share, and several tasks."""
    import random

    from quillmatch.operators import overlap

    draw = random.Random(7)
    common = list(range(40))
    works = []
    for k in range(60):
        base = [draw.randrange(1000, 4000) for _ in range(draw.choice([3, 20, 90]))]
        for _ in range(draw.choice([1, 2, 5])):
            kept = [draw.randrange(5000, 9000) if draw.random() < draw.choice([0.0, 0.1, 0.5]) else x for x in base]
            works.append(sorted({*kept, *draw.sample(common, draw.choice([0, 8, 40]))}))
    works = [[(x * 0x9E3779B97F4A7C15 + 12345) % (1 << 64) - (1 << 63) for x in w] for w in works]
    works.append([])
    ids = [(k * 0xD6E8FEB86659FD93) % (1 << 64) - (1 << 63) for k in range(len(works))]
    rows = [(i, w) for i, w in zip(ids, works)] + [(ids[k], works[k]) for k in (0, 5, 9)]
    df = spark.createDataFrame(rows, "id long, grams array<long>").repartition(4)
    for least in (0.23, 0.45, 0.9):
        expected = {}
        for i in range(len(works)):
            for j in range(i):
                a, b = set(works[i]), set(works[j])
                if a and b and len(a & b) / len(a | b) >= least:
                    expected[frozenset((ids[i], ids[j]))] = (len(a & b), len(a) + len(b))
        got = overlap.overlaps(df, least).collect()
        assert expected and len(got) == len(expected)
        assert {frozenset((r["a"], r["b"])): (r["n_common"], r["n_a"] + r["n_b"]) for r in got} == expected


def test_shared_grams_shuffles_no_rows_of_grams(spark):
    """Grams travel in arrays: no exchange carries a row for each, nor sets for each pair."""
    f = spark.createDataFrame([("a", "x", list(range(9))), ("b", "x", list(range(9)))], "filepath string, collection_id string, tokens array<int>")
    plan = pairs.shared_grams(f, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "array_intersect" not in plan


def _near_copies(n: int) -> list[tuple[int, list[int]]]:
    spread = lambda x: (x * 0x9E3779B97F4A7C15 + 12345) % (1 << 64) - (1 << 63)
    return [(spread(k), [spread(1000 + x) for x in range(50)] + [spread(9000 + k)]) for k in range(n)]


def test_overlaps_keeps_no_shuffle_of_its_steps(spark):
    """Each step's shuffles go when its result is written; the result is no plan over all of them."""
    import time

    from quillmatch.operators import overlap

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held() -> set[str]:
        files = disk.getAllFiles()
        return {x for k in range(files.size()) if (x := files.apply(k).getName()).startswith("shuffle_") and x.endswith(".data")}

    before = held()
    got = overlap.overlaps(spark.createDataFrame(_near_copies(12), "id long, grams array<long>"), 0.5).collect()
    assert len(got) == 66 and {r["n_common"] for r in got} == {50}
    for _ in range(50):  # files are deleted behind the query
        if not held() - before:
            break
        time.sleep(0.2)
    assert not held() - before


def test_pairs_of_near_copies_are_counted_in_one_place(spark, monkeypatch):
    """A group's works travel to one place, and to few blocks of it where its pairs are many."""
    from quillmatch.operators import overlap

    ids = [k for k, _ in _near_copies(40)]
    rows = [(a, b) for a in ids for b in ids if a < b]
    pairs = spark.createDataFrame(rows, "a long, b long")
    placed = overlap._placed(pairs, 1000).collect()
    assert {(r["a"], r["b"]) for r in placed} == set(rows) and len({r["bucket"] for r in placed}) == 1
    monkeypatch.setattr(overlap, "BLOCK", 100)
    placed = overlap._placed(pairs, 1_000_000).collect()
    assert {(r["a"], r["b"]) for r in placed} == set(rows) and len(placed) == len(rows)
    places = {x: {r["bucket"] for r in placed if x in (r["a"], r["b"])} for x in ids}
    assert len({r["bucket"] for r in placed}) > 1 and max(map(len, places.values())) <= 4
