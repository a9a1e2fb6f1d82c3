"""Readers that give lines with a file name and a line number, and writers."""
