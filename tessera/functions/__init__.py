"""Part of tessera: see the README for what each part holds."""
