"""A small generated code corpus with known definitions and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sources(n: int = 8) -> list[tuple[str, str, str]]:
    out = []
    for i in range(n):
        j = (i + 1) % n
        out += [
            ("alpha", f"lib/mod_{i}.py", f"# compute_{i} in a comment\ndef compute_{i}(x):\n    return compute_{j}(x) + 1\n\n\nclass Holder{i}:\n    def run(self):\n        return compute_{i}(2)\n"),
            ("alpha", f"src/part_{i}.c", f'/* compute_{i} */\nstruct item_{i} {{ int v; }};\nint compute_{i}(int x) {{\n    log_line("compute_{i}");\n    return compute_{j}(x) + 1;\n}}\n'),
            ("beta", f"App/Part{i}.cs", f'namespace App {{\n  public class Part{i} {{\n    // compute_{i}\n    public int compute_{i}(int x) {{ return compute_{j}(x) + 1; }}\n#if DEBUG\n    void Debug{i}() {{ compute_{i}(0); }}\n#endif\n  }}\n}}\n'),
            ("beta", f"web/view_{i}.ts", f"export class View{i} {{ show() {{ return compute_{i}(1); }} }}\nfunction compute_{i}(x: number) {{ return x; }}\n"),
            ("beta", f"doc/notes_{i}.md", f"compute_{i} is described here\n"),
        ]
    out.append(("beta", "App/Resources.Designer.cs", "class Resources { int compute_0() { return 0; } }\n"))
    return out


def corpus(spark: SparkSession, n: int = 8) -> DataFrame:
    return spark.createDataFrame(sources(n), "root string, path string, text string")
