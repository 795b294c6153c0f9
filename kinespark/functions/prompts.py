"""Messages and prompts of training and evaluation rows, routing by subject, and checks of responses, as column expressions.

System texts, question forms and suffixes are parameters: they are configuration, not logic. A task or subject that is in
no list is an error, as a typing mistake there would train or test on the wrong data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import strip

#: Tasks, those asked with a mark before the question, and the one shown as an image; fixed values.
IMAGE_TASK, TRACKED_TASK = "visual QA", "temporal-spatial free-form QA"
TASKS = (IMAGE_TASK, TRACKED_TASK, "temporal QA", "General video QA MCQ", "General video QA Free-form")
ALL_TASKS = (*TASKS[:3], "temporal QA (MCQ)", *TASKS[3:])
MARKED_TASKS, QUESTION_MARK = TASKS[2:], "Question: "
#: Subjects by the folder of their domain; fixed values.
DOMAINS = {
    "Art": ("Art", "Art_Theory", "Design", "Music"),
    "Science": ("Biology", "Chemistry", "Geography", "Math", "Physics"),
    "Humanities": ("History", "Literature", "Sociology", "Psychology"),
    "Engineering": ("Agriculture", "Architecture_and_Engineering", "Computer_Science", "Electronics", "Energy_and_Power", "Materials", "Mechanical_Engineering"),
    "Medicine": ("Basic_Medical_Science", "Clinical_Medicine", "Diagnostics_and_Laboratory_Medicine", "Pharmacy", "Public_Health"),
    "Business": ("Accounting", "Economics", "Finance", "Manage", "Marketing"),
}


def chosen(key: Column, values: dict[str, Column], what: str) -> Column:
    """The value of a key; an error for a key without one."""
    wrong = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(key, F.lit("null"))))
    return F.coalesce(*[F.when(key == k, v) for k, v in values.items()], wrong.cast("string"))


def domain(subject: Column) -> Column:
    return chosen(subject, {s: F.lit(d) for d, held in DOMAINS.items() for s in held}, "subject")


def _message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def _part(kind: Column, value: Column | None = None) -> Column:
    return F.struct(kind.alias("type"), (F.lit(None).cast("string") if value is None else value).alias("value"))


def conversation(task: Column, question: Column, systems: dict[str, str]) -> Column:
    """array<struct<role, content array<struct<type, value>>>>: the task's system text, then a place for its image or video and the question."""
    system = chosen(task, {t: F.lit(systems[t]) for t in ALL_TASKS}, "task")
    medium = F.when(task == IMAGE_TASK, "image").otherwise("video")
    return F.array(_message("system", _part(F.lit("text"), system)), _message("user", _part(medium), _part(F.lit("text"), question)))


def training_messages(task: Column, source: Column, path: Column, question: Column, thought: Column, answer: Column, systems: dict[str, str], roots: dict[str, str], own_roots: dict[str, str]) -> Column:
    """The three messages of a training row: what a conversation has, with the medium's path below its root, and the answer after its thought.

    roots are by task; own_roots are by source, for tracked rows that lie elsewhere.
    """
    system = chosen(task, {t: F.lit(systems[t]) for t in TASKS}, "task")
    root = chosen(task, {t: F.lit(roots[t]) for t in TASKS}, "task")
    elsewhere = F.coalesce(*[F.when((task == TRACKED_TASK) & (source == s), r) for s, r in own_roots.items()], F.lit(None).cast("string"))
    root = F.coalesce(elsewhere, root)
    whole = F.when(path.startswith("/"), path).when(root.endswith("/"), F.concat(root, path)).otherwise(F.concat(root, F.lit("/"), path))
    asked = F.when(task.isin(*MARKED_TASKS), F.concat(F.lit(QUESTION_MARK), question)).otherwise(question)
    medium = F.when(task == IMAGE_TASK, "image").otherwise("video")
    said = F.concat(F.lit("<think>"), thought, F.lit("</think>\n<answer>"), answer, F.lit("</answer>"))
    return F.array(_message("system", _part(F.lit("text"), system)), _message("user", _part(medium, whole), _part(F.lit("text"), asked)), _message("assistant", _part(F.lit("text"), said)))


def lettered(options: Column, form: str = "{}. ") -> Column:
    """Options on a line each, with their letters."""
    before, after = form.split("{}")
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.lit(before), F.char(65 + i), F.lit(after), o)), "\n")


def categorised(question: Column, options: Column, category: Column, mark: str, suffixes: dict[str, str], thinking: str = "", form: str = "{}. ") -> Column:
    """A question with its options, its category after a mark, and the category's suffix, if it has one."""
    more = F.coalesce(*[F.when(category == c, F.concat(F.lit("\n"), F.lit(s))) for c, s in suffixes.items()], F.lit(""))
    return F.concat(question, F.lit("\n"), lettered(options, form), F.lit(f"\n{mark}"), category, more, F.lit(f"\n{thinking}" if thinking else ""))


def filled(template: str, **values: Column) -> Column:
    """A template with the columns in place of their names in braces."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def whole_seconds(start: Column, end: Column) -> Column:
    """The whole seconds from start to end; none if none lies between."""
    a, b = F.ceil(start), F.floor(end)
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def grounding_values(item: dict[str, Column]) -> dict[str, Column]:
    """What the prompts of grounded questions name: length (seconds to two places), size, seconds (the list), first, boxes."""
    seconds = whole_seconds(F.get(item["timestamps"], 0), F.get(item["timestamps"], 1))
    length = F.round(item["frame_count"] / item["fps"], 2)
    return {
        "length": length.cast("string"),
        "size": F.concat_ws("x", item["width"].cast("string"), item["height"].cast("string")),
        "seconds": F.concat(F.lit("["), F.array_join(seconds.cast("array<string>"), ", "), F.lit("]")),
        "first": F.get(seconds, 0).cast("string"),
        "boxes": F.size(item["bboxes"]).cast("string"),
    }


def checklist(response: Column) -> Column:
    """struct of seven flags, grounded and motion: which tags a response has. A null response has none."""
    text = F.coalesce(response, F.lit(""))
    has = {t: text.contains(f"<{t}>") for t in ("think", "answer", "obj", "box")}
    has |= {"time": text.rlike("<t>[\\d.]+</t>s"), "tag": text.rlike("<motion\\s+[^/]*?/>"), "sentence": text.contains("<motion>") & text.contains("</motion>")}
    return F.struct(*[c.alias(n) for n, c in has.items()], (has["obj"] & has["box"] & has["time"]).alias("grounded"), (has["tag"] | has["sentence"]).alias("motion"))


#: What stands between words in a shown response; fixed values.
ACTION = "<obj>.*?</obj><box>.*?</box>at<t>.*?</t>s|<motion\\s+[^/]*?/>|<t>.*?</t>"
SIGHTING = "<obj>(.*?)</obj><box>(\\[.*?\\])</box>at<t>(\\d+\\.?\\d*)</t>s"
MOVE = '<motion\\s+obj="([^"]*?)"\\s+dir="([^"]*?)"\\s+speed="([^"]*?)"\\s+scale="([^"]*?)"\\s*/>'
MOMENT = "<t>(\\d+\\.?\\d*)</t>"


def shown_steps(text: Column) -> Column:
    """array<struct<kind, text, name, box, time>>: a response in order as words, and as sightings, moves and moments.

    A tag that says none of these, as one whose box is no list of numbers, is taken as its words.
    """
    text = F.coalesce(text, F.lit(""))
    gaps, tags = F.split(text, ACTION), F.regexp_extract_all(text, F.lit(ACTION), F.lit(0))
    none = F.lit(None).cast("string")

    def step(kind: str, shown: Column, name: Column = none, box: Column = none, time: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), shown.alias("text"), name.alias("name"), F.from_json(box, "array<double>").alias("box"), time.cast("double").alias("time"))

    def words(part: Column) -> Column:
        found = F.filter(F.split(strip(part), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
        return F.transform(found, lambda w: step("word", w))

    def action(tag: Column) -> Column:
        got = lambda p, k: F.regexp_extract(tag, p, k)
        box = F.from_json(got(SIGHTING, 2), "array<double>")
        sound = tag.rlike(SIGHTING) & box.isNotNull() & ~F.exists(box, lambda v: v.isNull())
        label = F.concat(F.lit("["), got(MOVE, 1), F.lit(": "), got(MOVE, 2), F.lit(" "), got(MOVE, 3), F.lit(" "), got(MOVE, 4), F.lit("]"))
        return F.when(sound, F.array(step("sighting", tag, got(SIGHTING, 1), got(SIGHTING, 2), got(SIGHTING, 3)))).when(~tag.rlike(SIGHTING) & tag.rlike(MOVE), F.array(step("move", label, got(MOVE, 1)))).when(~tag.rlike(SIGHTING) & tag.rlike(MOMENT), F.array(step("moment", strip(tag), time=got(MOMENT, 1)))).otherwise(words(tag))

    return F.flatten(F.zip_with(gaps, tags, lambda g, t: F.concat(words(F.coalesce(g, F.lit(""))), F.when(t.isNotNull(), action(t)).otherwise(F.array().cast("array<struct<kind:string,text:string,name:string,box:array<double>,time:double>>")))))
