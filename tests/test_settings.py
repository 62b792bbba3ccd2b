from annalist import settings


def test_project_roots(spark, tmp_path):
    (tmp_path / "app" / ".git").mkdir(parents=True)
    (tmp_path / "app" / "src" / "deep").mkdir(parents=True)
    deep, bare = str(tmp_path / "app" / "src" / "deep"), str(tmp_path)
    assert settings.project_root(deep) == str(tmp_path / "app")
    assert settings.project_root(bare) == bare
    rows = spark.createDataFrame([(deep,), (deep,), (None,)], "cwd string")
    assert [r[0] for r in rows.select(settings.project_roots(rows.cwd)).collect()] == [str(tmp_path / "app")] * 2 + [None]


def test_settings_files():
    text = "# no\nA=1\nexport B = 'two words' # c\nC=\"#x\"\nbad line\nD=x # y\n"
    assert settings.settings(text, {"A": "9", "Z": "0"}) == {"A": "9", "B": "two words", "C": "#x", "D": "x"}


def test_stores(tmp_path):
    (tmp_path / "p" / ".git").mkdir(parents=True)
    here = str(tmp_path / "p")
    assert settings.store_root(here, "/x") == "/x"
    assert settings.store_root(here, None, "local") == f"{here}/.annalist"
    assert settings.store_root(here, environment="/env") == "/env"
    (tmp_path / "p" / ".annalist").mkdir()
    assert settings.store_root(here) == f"{here}/.annalist"
    assert settings.store_root(here, scope="global", shared="/s") == "/s"
