"""Prompts for a language model that names techniques, as column expressions; the model itself is external."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is asked for, by kind of input, and the examples of the few-shot form.
ASK = {
    "report": "Name the ids and names of all (sub)techniques that occur in the report at the end. Be brief, don't guess, don't repeat any.",
    "sentence": "Name the ids and names of all (sub)techniques that occur in the sentence at the end. There may be none. Be brief, give no reasons.",
    "judge": "Which of these (sub)techniques does the sentence at the end describe? All that you name count as present.",
}
EXAMPLES = (
    ("The loader starts a shell and runs commands sent by its operator.", "T1059: Command and Scripting Interpreter"),
    ("Traffic to the control server goes through a proxy on the same host.", "T1090: Proxy"),
    ("Figure 4 shows the layout of the report.", "No technique found."),
)


def examples() -> Column:
    """The examples as lines, the same for every row."""
    return F.lit("\n".join(["Examples, which have nothing to do with the text to analyse:", *(f'- "{s}" -> {a}' for s, a in EXAMPLES)]))


def ask(kind: str, text: Column, few_shot: bool = False, entries: Column | None = None) -> Column:
    """The instruction, the entries that were retrieved or are to be judged, examples if asked for, and the text in grave accents. Null text gives null."""
    parts = [F.lit(ASK[kind])] + ([F.array_join(entries, "\n")] if entries is not None else []) + ([examples()] if few_shot else [])
    return F.concat(*[F.concat(p, F.lit("\n")) for p in parts], F.lit("`"), text, F.lit("`"))


def entry(label: Column, name: Column, description: Column) -> Column:
    """One candidate as a line; of its description only the first line."""
    return F.concat(F.lit("- "), label, F.lit(" - "), F.coalesce(name, F.lit("")), F.lit(": "), F.coalesce(F.get(F.split(description, "\n"), 0), F.lit("")))
