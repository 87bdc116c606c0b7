"""Column functions of pitch, time and text. All run in the JVM; there are no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pitch-class names: fixed values.
PITCH_CLASSES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
#: Keys in rank order, by tonic, as the results must list them: fixed values.
MAJOR_TONICS = ("C", "G", "D", "A", "E", "B", "F#", "F", "Bb", "Eb", "Ab", "Db")
MINOR_TONICS = ("A", "E", "B", "F#", "C#", "D", "G", "C", "F", "Bb", "Eb", "Ab")
FLATS = {"Bb": "A#", "Eb": "D#", "Ab": "G#", "Db": "C#"}
STEPS = {"major": (0, 2, 4, 5, 7, 9, 11), "minor": (0, 2, 3, 5, 7, 8, 10)}


def scales() -> list[tuple[str, tuple[int, ...]]]:
    """(key, pitch-class numbers) in rank order; built from the tonics and the steps."""
    return [(f"{tonic} {mode}", tuple((PITCH_CLASSES.index(FLATS.get(tonic, tonic)) + s) % 12 for s in STEPS[mode])) for mode, tonics in (("major", MAJOR_TONICS), ("minor", MINOR_TONICS)) for tonic in tonics]


def valid_frequency(f: Column) -> Column:
    return (f > 0) & ~F.isnan(f) & (f < F.lit(float("inf")))


def valid_time(t: Column) -> Column:
    return t.isNotNull() & ~F.isnan(t) & (F.abs(t) < F.lit(float("inf")))


def base_name(path: Column) -> Column:
    """What follows the last separator of a path or URL."""
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def unescaped(url: Column) -> Column:
    """A path without percent escapes; a plus sign and a stray percent sign stay."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def midi_to_hz(midi: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - F.lit(69.0)) / F.lit(12.0))


def hz_to_midi(f: Column) -> Column:
    """Fractional MIDI number."""
    return F.lit(12.0) * (F.log2(f) - F.log2(F.lit(440.0))) + F.lit(69.0)


def nearest_midi(f: Column) -> Column:
    """MIDI number, halves to even."""
    return F.rint(hz_to_midi(f)).cast("int")


def note_name(midi: Column) -> Column:
    names = F.array(*map(F.lit, PITCH_CLASSES))
    return F.concat(F.element_at(names, (F.pmod(midi, F.lit(12)) + 1).cast("int")), ((midi / 12).cast("int") - 1).cast("string"))


def note_to_midi(note: Column) -> Column:
    """MIDI number of a name such as A#4 or Bb-1; null for what is no note."""
    letter = F.regexp_extract(note, r"^\s*([A-Ga-g])[#b♯♭]*-?\d+\s*$", 1)
    sign = F.regexp_extract(note, r"^\s*[A-Ga-g]([#b♯♭]*)", 1)
    octave = F.regexp_extract(note, r"(-?\d+)\s*$", 1).try_cast("int")
    base = F.element_at(F.array(*map(F.lit, (9, 11, 0, 2, 4, 5, 7))), F.ascii(F.upper(letter)) - 64)
    shift = F.length(F.regexp_replace(sign, "[^#♯]", "")) - F.length(F.regexp_replace(sign, "[^b♭]", ""))
    return F.when(letter != "", (octave + 1) * 12 + base + shift)


def pitch_class(midi: Column) -> Column:
    """0 to 11; -1 below octave 0, whose names are in no scale and no chord."""
    return F.when(midi >= 12, F.pmod(midi, F.lit(12)).cast("int")).otherwise(F.lit(-1))


def pitch_class_name(midi: Column) -> Column:
    """The name without its digits; ``C-`` and the like below octave 0."""
    return F.trim(F.regexp_replace(note_name(midi), "[0-9]", ""))


def cents_apart(a: Column, b: Column) -> Column:
    return F.abs(a - b) * F.lit(100.0)


def gap_mark(gap: Column) -> Column:
    """How far two notes of a leadsheet stand apart."""
    return F.when(gap < 0.3, " ").when(gap < 0.8, " - ").when(gap < 2.0, " -- ").otherwise(" --- ")


def frame_at(time: Column, sample_rate: int, hop: int = 512) -> Column:
    """Index of the analysis frame at a time."""
    return F.floor(F.floor(time * F.lit(float(sample_rate))) / F.lit(hop)).cast("int")


def rounded_text(x: Column, places: int) -> Column:
    """Decimal text; rounds the exact binary value, halves to even, as C's printf does."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places if places else "0"))


def three(x: Column) -> Column:
    return rounded_text(x, 3)


LRC_LINE = r"^\[(\d{2}):(\d{2})(?:\.(\d{2}))?\](.*)"
LRC_TAGS = ("[ti:", "[ar:", "[al:", "[by:")


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def lrc_timestamp(line: Column) -> Column:
    part = lambda i: F.regexp_extract(line, LRC_LINE, i).try_cast("double")
    return F.when(line.rlike(LRC_LINE), part(1) * 60 + part(2) + F.coalesce(part(3), F.lit(0.0)) / 100)


def lrc_text(line: Column) -> Column:
    return stripped(F.regexp_extract(line, LRC_LINE, 4))
