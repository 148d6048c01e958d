from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"
