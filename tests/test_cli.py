import json

from grainline import cli
from test_catalog import BASE


def test_command_line(tmp_path, capsys):
    (tmp_path / "good.yaml").write_text(BASE)
    (tmp_path / "bad.yaml").write_text(BASE.replace("column: t", "column: none"))
    assert cli.main(["catalog", "validate", str(tmp_path / "good.yaml")]) == 0
    assert json.loads(capsys.readouterr().out)["passed"]
    assert cli.main(["catalog", "validate", str(tmp_path / "bad.yaml")]) == 1
    assert json.loads(capsys.readouterr().out)["issues"][0]["path"] == "dimensions.d"
    assert cli.main(["catalog", "compatibility", str(tmp_path / "good.yaml")]) == 0
    assert cli.main(["catalog", "validate", str(tmp_path / "none.yaml")]) == 1
