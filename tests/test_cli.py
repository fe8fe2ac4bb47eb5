import subprocess
import sys


def test_cli_lists_every_registered_report():
    from fleetlens.registry import load_all
    out = subprocess.run([sys.executable, "-m", "fleetlens", "list"], capture_output=True, text=True, timeout=120,
                         cwd=__import__("os").path.dirname(__import__("os").path.dirname(__file__)))
    assert out.returncode == 0
    listed = {line.split()[0] for line in out.stdout.splitlines() if line.strip()}
    assert listed == set(load_all())
