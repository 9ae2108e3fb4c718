"""Scalar rules of recorded sessions as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F


def key_text(c):
    """A key's text without the quotes around it."""
    return F.btrim(c, F.lit("'"))


def key_label(c):
    """Special keys without their prefix and single characters, both in upper case; others as they are."""
    return F.when(c.startswith("Key."), F.upper(F.regexp_replace(c, "^Key\\.", ""))).when(F.length(c) == 1, F.upper(c)).otherwise(c)


def ellipsis(c, n: int = 45):
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def size_of(c):
    """``WxH`` as a struct of two integers."""
    p = F.split(c, "x")
    return F.struct(p[0].cast("int").alias("width"), p[1].cast("int").alias("height"))


def scheduled(step, initial, sustain, warmup, ramp):
    """A parameter's value at a step: held, then linear, then sustained; without ramp steps it jumps."""
    t = (step - warmup) / F.nullif(ramp, F.lit(0))
    return F.when(step < warmup, initial).when((ramp > 0) & (step < warmup + ramp), initial + (sustain - initial) * t).otherwise(sustain)


def refinement_priority(novelty):
    return F.lit(1.0) + (F.lit(1.0) - F.least(novelty, F.lit(1.0)))


def overflow_eta(level, rate, capacity):
    """Seconds until a stage is full: 0 when it is, -1 when it never will be."""
    return F.when(level >= capacity, 0.0).when(rate <= 0, -1.0).otherwise((capacity - level) / rate)


def downscaled(width, height, area: int = 512 * 512):
    """Width and height of at most ``area`` pixels with the aspect kept; smaller images stay."""
    aspect = width / height
    h = F.floor(F.sqrt(F.lit(area) / aspect))
    fits = width * height <= area
    return F.struct(F.when(fits, width).otherwise(F.floor(aspect * h)).cast("int").alias("width"), F.when(fits, height).otherwise(h).cast("int").alias("height"))


def matches_exe(target: str, path, name):
    return path.contains(target) | (name == target) | path.endswith(target)


def match_mode(target: str) -> str:
    """How ``auto`` reads a target: as a program if it looks like one, else as a title."""
    return "exe" if target.lower().endswith(".exe") or "/" in target or "\\" in target else "title"


def matches_title(target: str, title):
    return title.contains(target)


def same_program(a, b):
    """Two window contexts of one program, whatever their titles; unknown windows match nothing."""
    return F.coalesce(a["exe_path"] == b["exe_path"], F.lit(False))


def same_process(a, b):
    return F.coalesce(a["pid"] == b["pid"], F.lit(False))


# Programs of the system, titles of controls, and generic titles that are no windows to record.
SYSTEM_PROGRAMS = ["explorer.exe", "searchhost.exe", "shellexperiencehost.exe", "textinputhost.exe", "systemsettings.exe", "applicationframehost.exe", "lockapp.exe", "startmenuexperiencehost.exe", "searchui.exe", "widgets.exe", "widgetservice.exe"]
CONTROL_TITLES = [
    "MSCTFIME UI", "Default IME", "IME", "MediaContextNotificationWindow", "Dismiss", "View Update", "Tree View", "ShellView", "Navigation buttons", "Up band toolbar", "Address band toolbar",
    "SearchEditBox", "Ribbon", "UIRibbonDockTop", "UIRibbonDockBottom", "UIRibbonDockLeft", "UIRibbonDockRight", "Edit", "Button", "Static", "ComboBox", "ListBox",
]


def recordable(title, exe_name, width, height, visible):
    """Whether a window may be recorded: visible, 100 by 50 pixels or more, titled, and neither a control nor a program of the system. An unknown size or visibility passes."""
    sized = F.coalesce((width >= 100) & (height >= 50), F.lit(True))
    titled = F.coalesce((F.length(title) >= 2) & ~title.isin(CONTROL_TITLES), F.lit(False))
    return F.coalesce(visible, F.lit(True)) & sized & titled & F.coalesce(~F.lower(exe_name).isin(SYSTEM_PROGRAMS), F.lit(False))


def seconds(us, places: int):
    """Whole microseconds as seconds with so many decimals, half up."""
    step, unit = 10 ** (6 - places), 10**places
    n = F.floor((us + step // 2) / step)
    return F.concat(F.floor(n / unit).cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), places, "0"))


def _seconds4(us):
    return seconds(us, 4)


def clip_name(start_us, quality):
    """The file of a clip: when it begins, and its quality."""
    return F.concat(F.lit("clip_"), seconds(start_us, 2), F.lit("_"), quality, F.lit(".mp4"))


def still_path(kind, us):
    """The file of a still, from a run's folder on."""
    return F.concat(F.lit("stills/"), kind, F.lit("_"), seconds(us, 4), F.lit(".png"))


def merged(base, over):
    """A map with the entries of ``over`` in place of those of ``base``; a null map has none."""
    base, over = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (base, over))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def interval_key(start_us, end_us):
    """``start-end`` in seconds with four decimals each."""
    return F.concat(_seconds4(start_us), F.lit("-"), _seconds4(end_us))


def scaled(x, of, to):
    """A coordinate of a frame of size ``of`` in a video of size ``to``, cut to an integer; an unknown frame size leaves it."""
    return F.when(F.coalesce(of, F.lit(0)) == 0, x.cast("int")).otherwise((x * (to / of)).cast("int"))


def fade(age, duration):
    """Opacity of what fades: 1 at its end, 0 after ``duration``; more than 1 before its end."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - age / duration)


def scroll_fade(age, duration):
    """Opacity of a scroll, which stays 1 until its end."""
    return F.when(age < 0, 1.0).otherwise(fade(age, duration))


def line_width(opacity):
    return F.greatest(F.lit(1), (opacity * 3).cast("int"))


def end_radius(opacity):
    return F.greatest(F.lit(3), (opacity * 6).cast("int"))


def ring_radius(age, duration):
    return (F.lit(10) + age / duration * 20).cast("int")


def trail_shown(t, end, duration, ahead=None):
    """Whether a path is shown: until ``duration`` after its end, and, unless ``ahead`` is None, from so long before it."""
    shown = t - end <= duration
    return shown if ahead is None else shown & (t - end >= -ahead)


def click_shown(t, at, duration):
    return (t - at >= 0) & (t - at <= duration)


key_shown = click_shown


def scroll_shown(t, start, end, duration):
    return (t >= start) & (t <= end + duration)


def time_offset(video_start, first_event):
    """What a video's clock begins at: its own start if that is a Unix time, else the first event."""
    return F.when(video_start > 1_000_000_000, video_start).otherwise(F.coalesce(first_event, F.lit(0.0)))


def even_quarter(n):
    """A quarter of a length, cut to an even number."""
    q = F.floor(n / 4)
    return (q - q % 2).cast("int")


def width_480p(width, height):
    """The width at a height of 480, raised to an even number."""
    w = (width * (F.lit(480) / height)).cast("int")
    return w + w % 2


def normalised_pixel(value, mean: float = 0.5, std: float = 0.5):
    return (value / 255.0 - mean) / std


def frame_bytes(frames, width, height, channels: int = 3, item: int = 1):
    return frames.cast("long") * width * height * channels * item


def natural_id(*parts):
    """An id that follows from what it names: SHA-256 of its parts."""
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts)), {"ignoreNullFields": "false"}), 256)
