"""Models that translate: a registry by name, an offline one, and patient calls."""

from __future__ import annotations

import json
import os
import string
import time
import urllib.error
import urllib.request
from collections.abc import Callable

#: A provider answers a message and a hint ("" for none).
Provider = Callable[[str, str], str]
PROVIDERS: dict[str, Callable[[], Provider]] = {}

_SWAP = str.maketrans(string.ascii_letters, string.ascii_uppercase + string.ascii_lowercase)


def provider(name: str) -> Callable[[Callable[[], Provider]], Callable[[], Provider]]:
    """Registers a function that makes a provider; it is called once a task."""

    def add(make: Callable[[], Provider]) -> Callable[[], Provider]:
        PROVIDERS[name] = make
        return make

    return add


@provider("mock")
def mock() -> Provider:
    """Swaps the case of ASCII letters, so that numbers and punctuation stay."""
    return lambda message, hint: json.dumps([{"i": x["i"], "t": x["t"].translate(_SWAP)} for x in json.loads(message)], ensure_ascii=False)


def patient(chat: Provider, retries: int = 3, pause: float = 1.5, longest: float = 8.0) -> Provider:
    """chat, called again after time-outs and broken connections, later each time; other errors pass. `repeats` counts calls made again."""

    def run(message: str, hint: str) -> str:
        for attempt in range(1, retries + 1):
            try:
                return chat(message, hint)
            except (TimeoutError, ConnectionError):
                run.repeats += 1
                time.sleep(min(longest, pause * attempt))
        return chat(message, hint)

    run.repeats = 0
    return run


# Address and model of services with the chat-completions protocol.
PRESETS = {
    "deepseek": ("https://api.deepseek.com", "deepseek-chat"),
    "siliconflow": ("https://api.siliconflow.cn/v1", "Qwen/Qwen3-8B"),
    "openai": ("https://api.openai.com/v1", "gpt-4o-mini"),
    "moonshot": ("https://api.moonshot.cn/v1", "moonshot-v1-8k"),
    "zhipu": ("https://open.bigmodel.cn/api/paas/v4", "glm-4-flash"),
    "dashscope": ("https://dashscope.aliyuncs.com/compatible-mode/v1", "qwen-plus"),
    "ollama": ("http://localhost:11434/v1", "qwen2.5:7b"),
    "custom": ("", ""),
}
AGAIN = {408, 429, 500, 502, 503, 504}
INSTRUCTION = 'Translate the text "t" of each item of the JSON array into {}. Answer with a JSON array of objects "i" and "t" alone. Keep all numbers.'


def hosted(base_url: str, model: str, key: str = "", language: str = "zh", timeout: float = 180.0) -> Provider:
    """A service with the chat-completions protocol. Time-outs, lost connections and busy services may be tried again
    (patient); other refusals raise."""

    def chat(message: str, hint: str) -> str:
        said = [{"role": "system", "content": f"{INSTRUCTION.format(language)} {hint}".strip()}, {"role": "user", "content": message}]
        request = urllib.request.Request(f"{base_url.rstrip('/')}/chat/completions", json.dumps({"model": model, "messages": said}).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"] or ""
        except urllib.error.HTTPError as e:
            if e.code in AGAIN:
                raise ConnectionError(f"status {e.code}") from e
            raise
        except urllib.error.URLError as e:
            if isinstance(e.reason, OSError) and "certificate" not in str(e.reason).lower():
                raise ConnectionError(str(e.reason)) from e
            raise

    return chat


def _preset(name: str) -> Callable[[], Provider]:
    """Reads address, model and key from <NAME>_BASE_URL, <NAME>_MODEL and <NAME>_API_KEY of the worker, else the preset."""

    def make() -> Provider:
        url, model = PRESETS[name]
        given = {k: os.environ.get(f"{name.upper()}_{k}", "") for k in ("BASE_URL", "MODEL", "API_KEY")}
        return hosted(given["BASE_URL"] or url, given["MODEL"] or model, given["API_KEY"])

    return make


for _name in PRESETS:
    provider(_name)(_preset(_name))
