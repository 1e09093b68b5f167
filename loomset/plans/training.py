"""Configuration files of trainers, written from one nested table of values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Training:
    """What a run trains. ``model`` has name_or_path, arch, script and what else a preset sets."""

    name: str
    folder: str
    trigger: str = ""
    dataset_type: str = "character"
    lead: str = "a photo of"
    model: dict = field(default_factory=dict)
    resolution: int = 1024
    buckets: tuple[int, ...] = ()
    rank: int = 16
    alpha: int = 16
    steps: int = 2000
    lr: float = 1e-4
    batch_size: int = 1
    num_repeats: int = 1


def sample_prompt(t: Training) -> str:
    who = t.trigger or t.name or "the subject"
    if t.dataset_type == "style":
        return f"{who}, a mountain landscape at sunset"
    subject = f"{t.lead} {who}".strip()
    return subject if t.dataset_type == "concept" else f"{subject}, standing outdoors in daylight"


def scalar(value: object) -> str:
    """A value that YAML and TOML read alike; texts on one line, quoted."""
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(scalar, value)) + "]"
    if isinstance(value, bool) or not isinstance(value, str):
        return json.dumps(value)
    return json.dumps(" ".join(value.split()), ensure_ascii=False)


def yaml(node: object, depth: int = 0) -> str:
    """Tables as mappings, lists of tables as sequences, all else as scalars."""
    pad, out = "  " * depth, []
    for key, value in node.items():
        if isinstance(value, dict):
            out.append(f"{pad}{key}:\n{yaml(value, depth + 1)}")
        elif isinstance(value, list) and value and isinstance(value[0], dict):
            items = [yaml(x, depth + 2) for x in value]
            out.append(f"{pad}{key}:\n" + "".join(f"{pad}  - {x[len(pad) + 4 :]}" for x in items))
        else:
            out.append(f"{pad}{key}: {scalar(value)}\n")
    return "".join(out)


def toml(node: dict, at: str = "") -> str:
    plain = "".join(f"{k} = {scalar(v)}\n" for k, v in node.items() if not isinstance(v, dict) and not (isinstance(v, list) and v and isinstance(v[0], dict)))
    out = plain
    for key, value in node.items():
        path = f"{at}{key}"
        if isinstance(value, dict):
            out += f"\n[{path}]\n{toml(value, path + '.')}"
        elif isinstance(value, list) and value and isinstance(value[0], dict):
            out += "".join(f"\n[[{path}]]\n{toml(x, path + '.')}" for x in value)
    return out


def job_config(t: Training) -> dict:
    """The nested job of a trainer that is configured by YAML."""
    m = {"quantize": True, "noise_scheduler": "flowmatch", "guidance": 4, "sample_steps": 20} | t.model
    model = {"name_or_path": m["name_or_path"], **({"is_flux": True} if m.get("is_flux") else {"arch": m["arch"]}), "quantize": m["quantize"]}
    process = {
        "type": "sd_trainer", "training_folder": "output", "device": "cuda:0",
        "network": {"type": "lora", "linear": t.rank, "linear_alpha": t.alpha},
        "save": {"dtype": "float16", "save_every": 250, "max_step_saves_to_keep": 4},
        "datasets": [{"folder_path": t.folder, "caption_ext": "txt", "caption_dropout_rate": 0.05, "shuffle_tokens": False, "cache_latents_to_disk": True, "resolution": list(t.buckets or (t.resolution,))}],
        "train": {"batch_size": t.batch_size, "steps": t.steps, "gradient_accumulation_steps": 1, "train_unet": True, "train_text_encoder": False, "gradient_checkpointing": True, "noise_scheduler": m["noise_scheduler"], "optimizer": "adamw8bit", "lr": t.lr, "dtype": "bf16"},
        "model": model,
        "sample": {"sample_every": 250, "width": t.resolution, "height": t.resolution, "prompts": [sample_prompt(t)], "guidance_scale": m["guidance"], "sample_steps": m["sample_steps"]},
    }
    return {"job": "extension", "config": {"name": t.name, "process": [process]}, "meta": {"name": "[name]", "version": "1.0"}}


def dataset_config(t: Training, subsets: bool) -> dict:
    """The dataset table of trainers that are configured by TOML, with its folder in the table or in a subset."""
    general = {"caption_extension": ".txt"}
    shape = {"resolution": [t.resolution, t.resolution], "batch_size": t.batch_size, "enable_bucket": True, "bucket_no_upscale": True}
    if subsets:
        return {"general": general | {"shuffle_caption": False}, "datasets": [shape | {"subsets": [{"image_dir": t.folder, "num_repeats": t.num_repeats}]}]}
    return {"general": general | shape, "datasets": [{"image_directory": t.folder, "cache_directory": f"{t.folder}/cache", "num_repeats": t.num_repeats}]}


def write_config(t: Training, form: str) -> str:
    """Writes the ``job``, ``dataset`` or ``subsets`` form into the dataset's folder, beside what is there."""
    from loomset.sources.packages import free_path

    suffix, text = (".yaml", yaml(job_config(t))) if form == "job" else (".toml", toml(dataset_config(t, form == "subsets")))
    path = free_path(Path(t.folder) / f"{form}{suffix}", ".")
    path.write_text(text, encoding="utf-8")
    return str(path)


#: What a command leaves for the user to fill in.
OPEN = "<<FILL: {}>>"


def _flags(values: dict[str, object]) -> str:
    """Options in order: a list repeats nothing but stands in one, True is a bare flag, False and None are none."""
    said = []
    for name, value in values.items():
        if value is True:
            said.append(f"--{name}")
        elif value is not None and value is not False:
            said.append(f"--{name} {value if not isinstance(value, Path) else json.dumps(value.as_posix())}")
    return " ".join(said)


def run_command(t: Training, form: str, config: str, install: str = "") -> str:
    """The line that starts a trainer from where it is installed; what isn't known stays open, to be filled in."""
    at = install.strip() or OPEN.format("where the trainer is installed")
    path = Path(config)
    if form == "job":
        return f'cd "{at}" && python run.py "{path.as_posix()}"'
    script = t.model.get("script") or OPEN.format("the training script")
    common = {"network_module": "networks.lora", "network_dim": t.rank, "network_alpha": t.alpha, "learning_rate": t.lr, "max_train_steps": t.steps, "output_dir": "output", "output_name": json.dumps(t.name, ensure_ascii=False)}
    if form == "subsets":
        model = {"pretrained_model_name_or_path": json.dumps(t.model.get("name_or_path") or OPEN.format("a base checkpoint"))}
    elif form == "dataset":
        model = {k: json.dumps(t.model.get(k) or OPEN.format(f"weights of the {k}")) for k in ("dit", "vae", "text_encoder")}
    else:
        raise ValueError(f"no form {form!r}; there are job, dataset and subsets")
    return f'cd "{at}" && accelerate launch {script} {_flags({"dataset_config": path} | model | common | t.model.get("flags", {}))}'
