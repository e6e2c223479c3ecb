"""Reading and writing of fields, particles and parameters."""
