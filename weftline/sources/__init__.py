"""Readers of file trees and JSON documents, and idempotent sinks."""
