"""Terminal sequences and terminals as tables.

A template holds %1 to %9 for arguments and %v for any number of them; `kind` says how
arguments are bounded and shown (see operators.terminal.Sequence).
"""

from __future__ import annotations

from dataclasses import dataclass

E = "\x1b"

# The sequences of each group, as name, template, number of arguments, kind.
VT100 = (
    ("reset_terminal_soft", f"{E}[!p", 0, "u8"),
    ("reset_terminal_hard", f"{E}c", 0, "u8"),
    ("reset_attributes", f"{E}[0m", 0, "u8"),
    ("clear", f"{E}[2J", 0, "u8"),
    ("enable_bold", f"{E}[1m", 0, "u8"),
    ("invert_colors", f"{E}[7m", 0, "u8"),
    ("cursor_to_top_left", f"{E}[0H", 0, "u8"),
    ("cursor_to_bottom_left", f"{E}[9999;1H", 0, "u8"),
    ("cursor_to_pos", f"{E}[%2;%1H", 2, "pos"),
    ("cursor_up", f"{E}[%1A", 1, "u16"),
    ("cursor_up_1", f"{E}[A", 0, "u8"),
    ("cursor_down", f"{E}[%1B", 1, "u16"),
    ("cursor_down_1", f"{E}[B", 0, "u8"),
    ("cursor_left", f"{E}[%1D", 1, "u16"),
    ("cursor_left_1", f"{E}[D", 0, "u8"),
    ("cursor_right", f"{E}[%1C", 1, "u16"),
    ("cursor_right_1", f"{E}[C", 0, "u8"),
    ("cursor_up_scroll", f"{E}M", 0, "u8"),
    ("cursor_down_scroll", f"{E}D", 0, "u8"),
    ("insert_cells", f"{E}[%1@", 1, "u16"),
    ("delete_cells", f"{E}[%1P", 1, "u16"),
    ("insert_rows", f"{E}[%1L", 1, "u16"),
    ("delete_rows", f"{E}[%1M", 1, "u16"),
    ("set_scrolling_rows", f"{E}[%1;%2r", 2, "pos"),
    ("enable_insert", f"{E}[4h", 0, "u8"),
    ("disable_insert", f"{E}[4l", 0, "u8"),
    ("enable_cursor", f"{E}[?25h", 0, "u8"),
    ("disable_cursor", f"{E}[?25l", 0, "u8"),
    ("enable_echo", f"{E}[12l", 0, "u8"),
    ("disable_echo", f"{E}[12h", 0, "u8"),
    ("enable_wrap", f"{E}[?7h", 0, "u8"),
    ("disable_wrap", f"{E}[?7l", 0, "u8"),
    ("reset_scrolling_rows", f"{E}[r", 0, "u8"),
    ("save_cursor_pos", f"{E}[s", 0, "u8"),
    ("restore_cursor_pos", f"{E}[u", 0, "u8"),
)
VT220 = VT100 + (
    ("enable_alt_screen", f"{E}[1049h", 0, "u8"),
    ("disable_alt_screen", f"{E}[1049l", 0, "u8"),
    ("query_primary_device_attributes", f"{E}[0c", 0, "u8"),
    ("primary_device_attributes", f"{E}[?%vc", 0, "u16"),
    ("reset_default_fg", f"{E}]110{E}\\", 0, "u8"),
    ("set_default_fg", f"{E}]10;rgb:%1/%2/%3{E}\\", 3, "u16hex"),
    ("query_default_fg", f"{E}]10;?{E}\\", 0, "u8"),
    ("reset_default_bg", f"{E}]111{E}\\", 0, "u8"),
    ("set_default_bg", f"{E}]11;rgb:%1/%2/%3{E}\\", 3, "u16hex"),
    ("query_default_bg", f"{E}]11;?{E}\\", 0, "u8"),
    ("query_text_area_size_cells", f"{E}[18t", 0, "u8"),
    ("text_area_size_cells", f"{E}[8;%1;%2t", 2, "u16"),
    ("query_text_area_size_px", f"{E}[14t", 0, "u8"),
    ("text_area_size_px", f"{E}[4;%1;%2t", 2, "u16"),
    ("query_cell_size_px", f"{E}[16t", 0, "u8"),
    ("cell_size_px", f"{E}[6;%1;%2t", 2, "u16"),
    ("begin_hyperlink", f"{E}]8;;", 0, "u8"),
    ("begin_hyperlink_anchor", f"{E}\\", 0, "u8"),
    ("end_hyperlink", f"{E}]8;;{E}\\", 0, "u8"),
)
REPEAT = (("repeat_char", f"{E}[%1b", 1, "u16"),)
SIXEL = (
    ("begin_sixels", f"{E}P%1;%2;%3q", 3, "u16"),
    ("end_sixels", f"{E}\\", 0, "u8"),
    ("enable_sixel_scrolling", f"{E}[?80l", 0, "u8"),
    ("disable_sixel_scrolling", f"{E}[?80h", 0, "u8"),
    ("set_sixel_advance_down", f"{E}[?8452l", 0, "u8"),
    ("set_sixel_advance_right", f"{E}[?8452h", 0, "u8"),
)
DIRECT = (
    ("set_color_fg_direct", f"{E}[38;2;%1;%2;%3m", 3, "u8"),
    ("set_color_bg_direct", f"{E}[48;2;%1;%2;%3m", 3, "u8"),
    ("set_color_fgbg_direct", f"{E}[38;2;%1;%2;%3;48;2;%4;%5;%6m", 6, "u8"),
)
COLOR256 = (
    ("set_color_fg_256", f"{E}[38;5;%1m", 1, "u8"),
    ("set_color_bg_256", f"{E}[48;5;%1m", 1, "u8"),
    ("set_color_fgbg_256", f"{E}[38;5;%1;48;5;%2m", 2, "u8"),
)
COLOR16 = (
    ("set_color_fg_16", f"{E}[%1m", 1, "aix_fg"),
    ("set_color_bg_16", f"{E}[%1m", 1, "aix_bg"),
    ("set_color_fgbg_16", f"{E}[%1;%2m", 2, "aix_fgbg"),
)
COLOR8 = (
    ("set_color_fg_8", f"{E}[%1m", 1, "fg8"),
    ("set_color_bg_8", f"{E}[%1m", 1, "bg8"),
    ("set_color_fgbg_8", f"{E}[%1;%2m", 2, "fgbg8"),
    ("reset_color_fg", f"{E}[39m", 0, "u8"),
    ("reset_color_bg", f"{E}[49m", 0, "u8"),
    ("reset_color_fgbg", f"{E}[39;49m", 0, "u8"),
)
FBTERM = (
    ("set_color_fg_16", f"{E}[1;%1}}", 1, "u8"),
    ("set_color_bg_16", f"{E}[2;%1}}", 1, "u8"),
    ("set_color_fgbg_16", f"{E}[1;%1}}{E}[2;%2}}", 2, "u8"),
    ("set_color_fg_256", f"{E}[1;%1}}", 1, "u8"),
    ("set_color_bg_256", f"{E}[2;%1}}", 1, "u8"),
    ("set_color_fgbg_256", f"{E}[1;%1}}{E}[2;%2}}", 2, "u8"),
)
KITTY = (
    ("begin_kitty_immediate_image_v1", f"{E}_Ga=T,f=%1,s=%2,v=%3,c=%4,r=%5,m=1,q=2{E}\\", 5, "u16"),
    ("end_kitty_image", f"{E}_Gm=0{E}\\", 0, "u8"),
    ("begin_kitty_image_chunk", f"{E}_Gm=1;", 0, "u8"),
    ("end_kitty_image_chunk", f"{E}\\", 0, "u8"),
)
KITTY_VIRTUAL = (("begin_kitty_immediate_virt_image_v1", f"{E}_Ga=T,U=1,q=2,f=%1,s=%2,v=%3,c=%4,r=%5,i=%6,m=1{E}\\", 6, "u16"),)
ITERM2 = (
    ("begin_iterm2_image", f"{E}]1337;File=inline=1;width=%1;height=%2;preserveAspectRatio=0:", 2, "u16"),
    ("end_iterm2_image", "\x07", 0, "u8"),
)
TMUX = (("begin_tmux_passthrough", f"{E}Ptmux;", 0, "u8"), ("end_tmux_passthrough", f"{E}\\", 0, "u8"))
SCREEN = (("begin_screen_passthrough", f"{E}P", 0, "u8"), ("end_screen_passthrough", f"{E}\\", 0, "u8"))
LF = (("enable_bold", f"{E}[1m", 0, "u8"), ("invert_colors", f"{E}[7m", 0, "u8"))


def _keys() -> tuple:
    """Keys: by themselves, with control (modifier 5) and with shift (modifier 2)."""
    # The final letters and the numbers of keys, and the few that follow no rule.
    letters = (("up", "A"), ("down", "B"), ("right", "C"), ("left", "D"), ("home", "H"), ("end", "F"))
    functions = (("f1", "P"), ("f2", "Q"), ("f3", "R"), ("f4", "S"))
    numbers = (("insert", 2), ("delete", 3), ("page_up", 5), ("page_down", 6), ("f5", 15), ("f6", 17), ("f7", 18), ("f8", 19), ("f9", 20), ("f10", 21), ("f11", 23), ("f12", 24))
    plain = {"return_key": "\r", "backspace_key": "\x7f", "tab_key": "\t", "tab_shift_key": f"{E}[Z"}
    out = list(plain.items())
    for name, c in letters + functions:
        lead = "[" if (name, c) in letters else "" if name == "f3" else "O"
        out += [(f"{name}_key", f"{E}{lead}{c}"), (f"{name}_ctrl_key", f"{E}[1;5{c}"), (f"{name}_shift_key", f"{E}[1;2{c}")]
    for name, n in numbers:
        out += [(f"{name}_key", f"{E}[{n}~"), (f"{name}_ctrl_key", f"{E}[{n};5~"), (f"{name}_shift_key", f"{E}[{n};2~")]
    return tuple((name, text, 0, "u8") for name, text in out)


KEYS = _keys()
ALL = VT220 + DIRECT + COLOR256 + COLOR16 + COLOR8 + SIXEL + REPEAT + KITTY + KITTY_VIRTUAL + ITERM2 + SCREEN + TMUX + KEYS


@dataclass(frozen=True)
class Rule:
    """A condition on a variable: is set, equals, begins with, ends with (case ignored) or has a version from value on.

    A required rule drops the terminal if it doesn't hold; of the others the highest priority counts.
    """

    name: str
    how: str
    value: str | None
    priority: int = 0
    required: bool = False


@dataclass(frozen=True)
class Terminal:
    type: str  # term, mux or app: an inner one is laid over the outer ones before it
    name: str
    variant: str | None
    version: str | None
    rules: tuple[Rule, ...]
    groups: tuple[tuple, ...]
    inherits: tuple[str, ...] = ()
    passthrough: str = "none"
    needs_passthrough: tuple[str, ...] = ()  # pixel modes
    sixel_overshoot: bool = False
    safe: str = "block+border"

    @property
    def identifier(self) -> str:
        parts = [self.name, self.variant or ("*" if self.version else None), self.version]
        return "-".join(p for p in parts if p)

    def sequences(self) -> dict[str, tuple[str, int, str]]:
        return {name: (template, n, kind) for group in self.groups for name, template, n, kind in group}


_FULL = (VT220, DIRECT, COLOR256, COLOR16, COLOR8)
_256 = (VT220, COLOR256, COLOR16, COLOR8)
_IMAGES = ("begin_sixels", "end_sixels", "begin_kitty_immediate_image_v1", "begin_kitty_immediate_virt_image_v1", "end_kitty_image", "begin_kitty_image_chunk", "end_kitty_image_chunk")
_LF = ("reset_attributes", "enable_bold", "invert_colors", "reset_default_fg", "set_default_fg", "reset_default_bg", "set_default_bg", *(n for g in (DIRECT, COLOR256, COLOR16, COLOR8) for n, *_ in g), *_IMAGES)
_PIXELS = ("sixels", "kitty", "iterm2")


def _is(name: str, value: str, priority: int = 0) -> Rule:
    return Rule(name, "exact", value, priority)


def _term(value: str, priority: int = 10) -> Rule:
    return _is("TERM", value, priority)


def _set(name: str, priority: int = 0) -> Rule:
    return Rule(name, "set", None, priority)


def _from(name: str, version: str) -> Rule:
    return Rule(name, "version", version, 0, True)


# The known terminals.
TERMINALS = (
    Terminal("term", "alacritty", None, None, (_term("alacritty"),), _FULL, sixel_overshoot=True),
    Terminal("term", "apple", None, None, (_is("TERM_PROGRAM", "Apple_Terminal"),), _256),
    Terminal("term", "contour", None, None, (_is("TERMINAL_NAME", "contour"),), (*_FULL, SIXEL)),
    Terminal("term", "ctx", None, None, (_set("CTX_BACKEND"),), (*_FULL, REPEAT)),
    Terminal("term", "eat", "truecolor", None, (_term("eat-truecolor"),), (*_FULL, SIXEL)),
    Terminal("term", "eat", "256color", None, (_term("eat-256color"),), (*_256, SIXEL)),
    Terminal("term", "eat", "16color", None, (_term("eat-16color"),), (VT220, COLOR16, COLOR8, SIXEL)),
    Terminal("term", "eat", "color", None, (_term("eat-color"),), (VT220, COLOR8, SIXEL)),
    Terminal("term", "eat", "mono", None, (_term("eat-mono"),), (VT220, SIXEL)),
    Terminal("term", "eat", "truecolor", None, (_set("EAT_SHELL_INTEGRATION_DIR"),), (*_FULL, SIXEL)),
    Terminal("term", "fbterm", None, None, (_term("fbterm"),), (VT220, FBTERM, COLOR8)),
    Terminal("term", "foot", None, None, (_term("foot"), Rule("TERM", "prefix", "foot-", 10)), (*_FULL, SIXEL)),
    Terminal("term", "ghostty", None, None, (_term("xterm-ghostty"), _is("TERM_PROGRAM", "ghostty"), _set("GHOSTTY_BIN_DIR")), (*_FULL, KITTY, KITTY_VIRTUAL)),
    Terminal("term", "hurd", None, None, (_term("hurd"),), (VT100, COLOR8), safe="ascii"),
    Terminal("term", "iterm", None, None, (_is("LC_TERMINAL", "iTerm2"), _is("TERM_PROGRAM", "iTerm.app")), (*_FULL, ITERM2)),
    Terminal("term", "kitty", None, None, (_term("xterm-kitty"), _set("KITTY_PID")), (*_FULL, KITTY, KITTY_VIRTUAL)),
    Terminal("term", "konsole", None, None, (_set("KONSOLE_VERSION"),), _FULL),
    Terminal("term", "konsole", None, "220370", (_set("KONSOLE_VERSION"), _from("KONSOLE_VERSION", "220370")), (*_FULL, SIXEL), sixel_overshoot=True),
    Terminal("app", "lf", None, None, (_set("LF_LEVEL"),), (LF, DIRECT, COLOR256, COLOR16, COLOR8), _LF),
    Terminal("term", "linux", None, None, (_term("linux"),), (VT220, COLOR16, COLOR8), safe="ascii"),
    Terminal("term", "mintty", None, None, (_term("mintty"), _is("TERM_PROGRAM", "mintty")), (*_FULL, ITERM2, SIXEL), sixel_overshoot=True),
    Terminal("term", "mlterm", None, None, (_term("mlterm"), _set("MLTERM")), (*_256, ITERM2, SIXEL), sixel_overshoot=True),
    Terminal("app", "neovim", None, None, (_set("NVIM"),), _256),
    Terminal("app", "neovim", "truecolor", None, (_is("COLORTERM", "truecolor"), _is("NVIM_TUI_ENABLE_TRUE_COLOR", "1"), Rule("NVIM", "set", None, 0, True)), _FULL),
    Terminal("term", "rio", None, None, (_term("rio"), _is("TERM_PROGRAM", "rio")), (*_FULL, ITERM2, SIXEL), sixel_overshoot=True),
    Terminal("term", "rxvt", "unicode", None, (_term("rxvt-unicode"),), (VT220, DIRECT, COLOR16, COLOR8)),
    Terminal("term", "rxvt", "unicode-256color", None, (_term("rxvt-unicode-256color"),), (VT220, DIRECT, COLOR16, COLOR8)),
    Terminal("mux", "screen", None, None, (Rule("TERM", "prefix", "screen", -5),), (*_256, SCREEN), _IMAGES, "screen", _PIXELS),
    Terminal("term", "st", None, None, (_term("st-256color"),), _FULL),
    Terminal("mux", "tmux", None, None, (_set("TMUX"), _is("TERM_PROGRAM", "tmux")), (*_FULL, TMUX), _IMAGES, "tmux", _PIXELS, True),
    Terminal("mux", "tmux", None, "3.4", (_set("TMUX"), _is("TERM_PROGRAM", "tmux"), _from("TERM_PROGRAM_VERSION", "3.4")), (*_FULL, TMUX), _IMAGES, "tmux", ("kitty", "iterm2"), True),
    Terminal("term", "vt220", None, None, (_set("TERM", -1000),), (VT220, COLOR8), safe="ascii"),
    Terminal("term", "vte", None, None, (_set("VTE_VERSION"),), _FULL),
    Terminal("term", "vte", None, "5202", (_set("VTE_VERSION"), _from("VTE_VERSION", "5202")), (*_FULL, REPEAT)),
    Terminal("term", "warp", None, None, (_is("TERM_PROGRAM", "WarpTerminal"),), (*_FULL, KITTY)),
    Terminal("term", "wezterm", None, None, (_is("TERM_PROGRAM", "WezTerm"), _set("WEZTERM_EXECUTABLE")), (*_FULL, SIXEL, ITERM2)),
    Terminal("term", "windows-console", None, None, (Rule("ComSpec", "suffix", "\\cmd.exe", -5),), _FULL),
    Terminal("term", "xterm", None, None, (_set("XTERM_VERSION"),), _FULL),
    Terminal("term", "xterm", None, None, (_term("xterm", -10),), _FULL),
    Terminal("term", "xterm", "256color", None, (_term("xterm-256color", -10),), _FULL),
    Terminal("term", "xterm", "direct", None, tuple(_term(f"xterm-direct{n}", -10) for n in ("", "2", "16", "256")), _FULL),
    Terminal("term", "yaft", None, None, (_term("yaft-256color"), _term("yaft")), (*_256, SIXEL)),
)
