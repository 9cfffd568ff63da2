"""Readers: Parquet tables, sequence text files, disassembly listings, ELF filters."""
