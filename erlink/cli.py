"""Command line: python -m erlink.cli VERB [--config F] [--split train|test|both] [--one-to-one] [--threshold T]."""

from __future__ import annotations

import argparse
import dataclasses
import os

from erlink.operators.decide import Calibration
from erlink.plans import linkage
from erlink.session import get_spark

VERBS = ["prepare", "block", "audit", "features", "train", "validation", "evaluate", "loo", "calibrate", "tune", "predict", "outputs", "diagnose", "all"]


def report(cfg: linkage.Config, verb: str, df) -> None:
    """Shows a verb's few result rows and stores them as JSON beside the outputs."""
    df = df.cache()
    df.show(truncate=False)
    df.coalesce(1).write.mode("overwrite").json(f"{cfg.output_dir}/reports/{verb}")
    df.unpersist()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="erlink")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("--config")
    p.add_argument("--split", choices=["train", "test", "both"], default="train")
    p.add_argument("--one-to-one", action="store_true")
    p.add_argument("--threshold", type=float)
    a = p.parse_args(argv)
    spark, cfg = get_spark(), linkage.Config.load(a.config)
    if a.threshold is not None:
        cfg = dataclasses.replace(cfg, threshold=a.threshold)
    splits = ["train", "test"] if a.split == "both" else [a.split]
    kept = f"{cfg.output_dir}/threshold.json"
    for verb in ["prepare", "block", "audit", "features", "train"] if a.verb == "all" else [a.verb]:
        for split in splits if verb in ("prepare", "block", "features", "predict", "outputs") else splits[:1]:
            if verb == "prepare":
                for name, df in linkage.prepare_split(spark, cfg, split).items():
                    print(split, name, df.count())
            elif verb in ("block", "features"):
                print(split, getattr(linkage, verb + "_split")(spark, cfg, split).count())
            elif verb in ("audit", "train", "diagnose"):
                report(cfg, verb, getattr(linkage, verb)(spark, cfg))
            elif verb in ("validation", "evaluate"):
                report(cfg, verb, linkage.validate(spark, cfg))
            elif verb == "loo":
                for country, df in linkage.leave_one_out(spark, cfg).items():
                    report(cfg, f"loo_{country}", df)
            elif verb in ("calibrate", "tune"):
                os.makedirs(cfg.output_dir, exist_ok=True)
                with open(kept, "w", encoding="utf-8") as f:
                    f.write(linkage.calibrate(spark, cfg).to_json())
            elif verb in ("predict", "outputs"):
                cal = Calibration(cfg.threshold)
                if a.threshold is None and os.path.exists(kept):
                    with open(kept, encoding="utf-8") as f:
                        cal = Calibration.from_json(f.read())
                linkage.predict(spark, cfg, split, a.one_to_one, cal)["distribution"].show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
