"""Command line and HTTP front ends on the driver."""
