"""Labels, header bits and command texts of recordings as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_KNOWN = "N/A"
# Names that are shown for codecs and containers, and batch formats of containers.
CODECS = {
    "h264": "H.264", "hevc": "HEVC", "mpeg2video": "MPEG-2", "mpeg1video": "MPEG-1", "mpeg4": "MPEG-4", "vc1": "VC-1", "av1": "AV1",
    "aac": "AAC", "aac_latm": "AAC", "ac3": "AC-3", "eac3": "E-AC-3", "mp2": "MP2", "mp3": "MP3", "dts": "DTS", "opus": "Opus", "flac": "FLAC",
}
SUBTITLES = {
    "dvb_subtitle": "DVB subtitles", "dvb_teletext": "DVB teletext", "hdmv_pgs_subtitle": "PGS (Blu-ray)", "dvd_subtitle": "DVD subtitles", "subrip": "SubRip text", "ass": "ASS text", "mov_text": "MP4 text",
}
# Names of MPEG-2 levels; of H.264 levels the greatest bit rate in kbit/s and its factor, and the buffer in KB.
MPEG2_LEVELS = {10: "Low", 8: "Main", 6: "High 1440", 4: "High"}
H264_RATES = {30: 10000, 31: 14000, 32: 20000, 40: 20000, 41: 50000, 42: 50000}
H264_RATE_FACTOR = 1250
H264_BUFFERS = {30: 228, 31: 320, 32: 458, 40: 572, 41: 1430, 42: 1430}
# Codecs that containers take, the first their default; those of containers that aren't listed stand under "".
SOUND_CODECS = {
    "mp3": ("libmp3lame",), "flac": ("flac",), "wav": ("pcm_s16le", "pcm_f32le"), "ogg": ("libopus", "libvorbis"), "m4a": ("aac",), "ipod": ("aac",), "mp4": ("aac", "libmp3lame"), "mov": ("aac", "libmp3lame"),
    "mkv": ("aac", "libmp3lame", "libopus", "flac", "pcm_s16le"), "webm": ("libopus", "libvorbis"), "avi": ("libmp3lame", "pcm_s16le"), "": ("aac", "libmp3lame"),
}
PICTURE_CODECS = {"mp4": ("h264", "hevc", "av1"), "mov": ("h264", "hevc"), "mkv": ("h264", "hevc", "vp9", "av1"), "webm": ("vp9", "av1"), "avi": ("h264",), "": ("h264", "hevc")}
# Containers of sound alone, those with one sound track at most, and pictures that containers can't hold.
SOUND_ONLY = ("mp3", "flac", "ogg", "wav", "m4a", "ipod")
ONE_TRACK = ("ogg", "mp3", "m4a", "flac", "wav")
NEVER = {"h264": ("ogg",), "hevc": ("mp3", "ogg")}
# Rate factors of qualities (1 low to 6 lossless); any other counts as normal, the second.
QUALITIES = {1: 23, 2: 18, 3: 14, 4: 8, 5: 3, 6: 0}
# Labels of field orders.
FIELD_ORDERS = ("Unknown", "Progressive", "Interlaced (top field first)", "Interlaced (bottom field first)", "Interlaced")
CONTAINERS = {"mpegts": "MPEG-TS", "matroska,webm": "MKV", "matroska": "MKV", "mov,mp4,m4a,3gp,3g2,mj2": "MP4", "mpeg": "MPEG-PS", "avi": "AVI"}


def named(code: Column, names: dict[str, str]) -> Column:
    """The name of a code, or the code itself; ``N/A`` for none."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(table, code), code, F.lit(NOT_KNOWN))


def _of(table: dict, key: Column) -> Column:
    """What a table of values has for a key, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def field_order(value: Column) -> Column:
    v = F.lower(value)
    unknown, progressive, top, bottom, other = FIELD_ORDERS
    return F.when(F.coalesce(v, F.lit("")) == "", unknown).when(v == "progressive", progressive).when(v.isin("tt", "tb"), top).when(v.isin("bb", "bt"), bottom).otherwise(other)


def profile_level(codec: Column, profile: Column, level: Column) -> Column:
    """``profile/n.n`` where the codec has numbered levels, ``profile@name`` where it has named ones, else the profile."""
    numbered = codec.isin("h264", "hevc") & (level > 0)
    name = F.when(codec.isin("mpeg2video", "mpeg1video"), _of(MPEG2_LEVELS, level.cast("int")))
    told = F.when(numbered, F.concat(profile, F.lit("/"), F.format_string("%.1f", level / 10))).when(name.isNotNull(), F.concat(profile, F.lit("@"), name)).otherwise(profile)
    return F.when(F.coalesce(profile, F.lit("")) == "", NOT_KNOWN).otherwise(told)


def level_limits(level: Column) -> Column:
    """Struct of rate (bits a second) and buffer (bytes) that an H.264 level allows; nulls for levels that aren't listed."""
    n = level.cast("int")
    return F.struct((_of(H264_RATES, n).cast("long") * H264_RATE_FACTOR).alias("rate"), (_of(H264_BUFFERS, n).cast("long") * 1024).alias("buffer"))


def container(extension: Column) -> Column:
    """A file's extension in lower case, without its dot."""
    return F.ltrim(F.lower(extension), F.lit("."))


def _codecs(table: dict[str, tuple[str, ...]], extension: Column) -> Column:
    lists = {k: F.array(*[F.lit(x) for x in v]) for k, v in table.items()}
    held = F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), v)])
    return F.coalesce(F.try_element_at(held, container(extension)), lists[""])


def sound_codecs(extension: Column) -> Column:
    """The sound codecs that a container takes, its default first."""
    return _codecs(SOUND_CODECS, extension)


def picture_codecs(extension: Column) -> Column:
    """The picture codecs that a container takes, its default first."""
    return _codecs(PICTURE_CODECS, extension)


def fitting_sound(codec: Column, extension: Column) -> Column:
    """The sound codec for a file: the container's own where that is one of sound alone, else the one that was asked for."""
    lower = F.lower(extension)
    return F.when(lower.isin(*SOUND_ONLY), F.get(sound_codecs(extension), 0)).otherwise(codec)


def rate_factor(quality: Column) -> Column:
    """The rate factor of a quality; lower is better."""
    return F.coalesce(_of(QUALITIES, quality.cast("int")), F.lit(QUALITIES[2]))


def container_faults(picture: Column, extension: Column, tracks: Column) -> Column:
    """What speaks against a picture codec and a number of sound tracks in a container: an array of texts."""
    ext = container(extension)
    codec = F.lower(F.trim(F.coalesce(picture, F.lit(""))))
    codec = F.when(codec == "h265", "hevc").otherwise(codec)
    no_picture = F.when((codec == "h264") & ext.isin(*NEVER["h264"]), F.lit("H.264 video codec is not supported in OGG containers"))
    no_picture = no_picture.when((codec == "hevc") & ext.isin(*NEVER["hevc"]), F.concat(F.lit("H.265 video codec is not supported in "), F.upper(ext), F.lit(" containers")))
    many = F.when((tracks > 1) & ext.isin(*ONE_TRACK), F.concat(F.upper(ext), F.lit(" format can only have 1 audio track, but "), tracks.cast("string"), F.lit(" were selected")))
    return F.array_compact(F.array(no_picture, many))


def stream_id(raw: Column, index: Column) -> Column:
    """``x`` and the stream's id in hexadecimal, from ``0x…`` or digits without a leading zero; other ids as they are; without one ``#`` and its index."""
    number = F.when(raw.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(raw, 3, 16), 16, 10).try_cast("long")).otherwise(F.when(raw.rlike(r"^(0+|[1-9]\d*)$"), raw.try_cast("long")))
    told = F.when(number.isNotNull(), F.concat(F.lit("x"), F.hex(number))).otherwise(raw)
    return F.coalesce(told, F.concat(F.lit("#"), index.cast("string")), F.lit(NOT_KNOWN))


def duration_timecode(seconds: Column, fps: Column) -> Column:
    """``HH:MM:SS.FF``; the part of a second is rounded to frames, at most the last of the second, or cut to hundredths without a rate."""
    whole = F.floor(seconds).cast("long")
    part = seconds - whole
    frames = F.bround(part * fps).cast("long")
    rate = F.bround(fps).cast("long")
    last = F.when(fps > 0, F.when(frames >= rate, rate - 1).otherwise(frames)).otherwise(F.floor(part * 100).cast("long"))
    text = F.format_string("%02d:%02d:%02d.%02d", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60, last)
    return F.when(seconds.isNull() | (seconds < 0), NOT_KNOWN).otherwise(text)


def _byte(data: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")


def header_channels(data: Column) -> Column:
    """Channel configuration in a sound frame's header (sync word of twelve ones); null where it is none."""
    sync = (F.octet_length(data) >= 4) & (_byte(data, 0) == 0xFF) & (_byte(data, 1).bitwiseAND(0xF0) == 0xF0)
    return F.when(sync, _byte(data, 2).bitwiseAND(1) * 4 + F.shiftright(_byte(data, 3).bitwiseAND(0xC0), 6))


def header_length(data: Column) -> Column:
    """Length in bytes that a sound frame's header gives for the frame; null where it is none."""
    bits = _byte(data, 3).bitwiseAND(3) * 2048 + _byte(data, 4) * 8 + F.shiftright(_byte(data, 5).bitwiseAND(0xE0), 5)
    return F.when(header_channels(data).isNotNull() & (F.octet_length(data) >= 7), bits)


def print_text(values: Column) -> Column:
    """A small picture (array of whole numbers from 0 to 255) as base64 text."""
    digits = F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")
    return F.regexp_replace(F.base64(F.unhex(digits)), r"\s", "")  # in one line


def print_values(text: Column) -> Column:
    """The numbers of a base64 text."""
    digits = F.hex(F.unbase64(text))
    return F.transform(F.filter(F.split(F.regexp_replace(digits, "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))


def frame_pairs(text: Column) -> Column:
    """Pairs (a, b) of a list of frames divided by commas; null for an odd number of them, or where one is no number."""
    parts = F.transform(F.split(text, ","), lambda x: F.when(x.rlike(r"^ *[+-]?\d{1,18} *$"), F.trim(x).cast("long")))
    ok = (F.size(parts) % 2 == 0) & ~F.exists(parts, lambda x: x.isNull())
    steps = F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1)
    return F.when(ok, F.transform(steps, lambda i: F.struct(F.get(parts, i * 2).alias("a"), F.get(parts, i * 2 + 1).alias("b"))))


def option_value(words: Column, options: tuple[str, ...] = ("-k", "--keep", "-c", "--cut"), others: tuple[str, ...] = ("-h", "--help", "--frames", "--version")) -> Column:
    """Values behind the given options in a command's words, a minus sign in front of a number being no option's."""
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*options))
    behind = F.transform(places, lambda i: F.get(words, i + 1))
    return F.filter(behind, lambda v: v.isNotNull() & ~v.startswith("--") & ~v.isin(*others))


def completion_line(label: Column, path: Column, seconds: Column, size: Column, frames: Column, took: Column) -> Column:
    """One line on a finished piece: name, length, megabytes, frames and the time it took."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    clock = [F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60]
    name = F.substring_index(F.coalesce(path, F.lit("")), "/", -1)
    figures = (_decimal(F.coalesce(size, F.lit(0)) / 1048576.0, "0"), F.coalesce(frames, F.lit(0)).cast("long"), _decimal(F.coalesce(took, F.lit(0.0)), "0.0"))
    return F.format_string("%s %s (%02d:%02d:%02d, %s MB, %d frames, %ss)", label, name, *clock, *figures)


def _decimal(value: Column, pattern: str) -> Column:
    """A number by a pattern like ``0.00``; halves of its exact value go to the even digit."""
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def subtitle_list(tracks: Column) -> Column:
    """Subtitle tracks (an array of codec and language) in one line, or ``None`` for none."""
    name = lambda x: F.coalesce(_of(SUBTITLES, x["codec"]), F.upper(F.when(F.coalesce(x["codec"], F.lit("")) == "", "?").otherwise(x["codec"])))
    each = F.transform(tracks, lambda x: F.when(F.coalesce(x["language"], F.lit("")) == "", name(x)).otherwise(F.concat(name(x), F.lit(" ("), x["language"], F.lit(")"))))
    return F.when(F.size(tracks) > 0, F.array_join(each, ", ")).otherwise("None")


def completion_lines(label: Column, stats: Column, notes: Column, errors: Column) -> Column:
    """The report on a finished file: an array of lines.

    ``stats`` is a struct of path, seconds, size, scenes, frames, sound_frames, sound_tracks, subtitles (an array of codec and
    language; null where the file couldn't be read), took, rate and bitrate; nulls count as 0.  ``notes`` and ``errors`` are
    arrays of label and text.
    """
    number = lambda name: F.coalesce(stats[name].cast("double"), F.lit(0.0))
    whole = lambda name: number(name).cast("long")
    line = lambda title, text: F.concat(F.lit(f"    {title:<16}: "), text)
    s = whole("seconds")
    clock = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
    head = [
        label, line("Output file", F.coalesce(stats["path"], F.lit(""))), line("Video length", clock), line("Video size", F.concat(_decimal(number("size") / 1048576.0, "0"), F.lit(" MB"))),
        *[line(title, whole(name).cast("string")) for title, name in (("Output scenes", "scenes"), ("Video frames", "frames"), ("Audio frames", "sound_frames"), ("Audio tracks", "sound_tracks"))],
        F.when(stats["subtitles"].isNotNull(), line("Subtitles", subtitle_list(stats["subtitles"]))),
        line("Processing time", F.concat(_decimal(number("took"), "0.0"), F.lit("s"))), line("Frames/sec", _decimal(number("rate"), "0")), line("Video bitrate", F.concat(_decimal(number("bitrate") / 1_000_000, "0.00"), F.lit(" Mbps"))),
    ]
    marked = lambda rows, mark: F.transform(rows, lambda x: F.concat(F.lit(f"    {mark} "), x["label"], F.lit(" - "), x["text"]))
    none = F.array().cast("array<string>")
    return F.concat(F.array_compact(F.array(*head)), F.coalesce(marked(notes, "*"), none), F.coalesce(marked(errors, "!"), none))


def batch_format(container: Column) -> Column:
    """The batch format (ts, mkv, mp4) of a container; ts where it has none of its own."""
    return F.when(container.isin("mkv", "mp4"), container).otherwise("ts")


def output_extension(fmt: Column, source: Column) -> Column:
    """``.mkv`` or ``.mp4`` by the batch format; for ts the source's own extension, or ``.ts``."""
    own = F.regexp_extract(F.substring_index(F.coalesce(source, F.lit("")), "/", -1), r"^.+?(\.[^.]*)$", 1)
    return F.when(fmt.isin("mkv", "mp4"), F.concat(F.lit("."), fmt)).when((fmt == "ts") & (own != ""), own).otherwise(".ts")
