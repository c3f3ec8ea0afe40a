import json

from treeloom.__main__ import main


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.py").write_text("def f():\n    pass\n")
    assert main(["list", "--filter", "typescript"]) == 0 and capsys.readouterr().out == "typescript\n1 languages\n"
    assert main(["info", "shell"]) == 0 and "language: bash" in capsys.readouterr().out
    assert main(["parse", "a.py"]) == 0 and capsys.readouterr().out.startswith("(module (function_definition")
    assert main(["parse", "a.py", "--format", "json"]) == 0 and json.loads(capsys.readouterr().out)["has_errors"] is False
    assert main(["process", "a.py", "--symbols", "--chunk-size", "8"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["symbols"][0]["name"] == "f" and "structure" not in got and len(got["chunks"]) > 1
    assert main(["parse", "nothing", "--language", "zz"]) == 1 if (tmp_path / "nothing").write_text("x") else False
    assert main(["init", "--languages", "python", "--cache-dir", "/c"]) == 0 and (tmp_path / "treeloom.toml").exists()
    assert main(["download", "python", "--groups", "data"]) == 0 and main(["download", "cobol"]) == 1 and main(["cache-dir"]) == 0


def test_completions(capsys):
    for shell in ("bash", "zsh", "fish"):
        assert main(["completions", shell]) == 0
        out = capsys.readouterr().out
        assert "process" in out and "chunk-size" in out and "cache-dir" in out


def test_configuration_files(tmp_path):
    """Any string survives being written and read; bad files raise by their kind."""
    import pytest

    from treeloom.plans.config import PackConfig
    from treeloom.plans.errors import ConfigError, IoError, TomlError

    odd = PackConfig('/a "b"/it\'s\\c\n\x01é', ("py'thon", 'q"'), ())
    assert PackConfig.load(odd.save(tmp_path)) == odd
    (tmp_path / "bad.toml").write_text("a = = b")
    with pytest.raises(TomlError):
        PackConfig.load(tmp_path / "bad.toml")
    with pytest.raises(IoError) as e:
        PackConfig.load(tmp_path / "none.toml")
    assert isinstance(e.value, ConfigError)
